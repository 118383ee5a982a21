"""Rows that every operator has to take, and plain-Python versions of the operators' results."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

CLASHING = ("ids", "words", "lines", "token", "component", "quern_word", "quern_bits", "parts", "anchor", "n", "bits", "score", "pii_counts", "start")


def odd_rows(seed: int = 5) -> list[tuple[int, str | None]]:
    """Nulls, empty texts, a very long one, copies, near copies and repeated passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 6)))
    passage = " ".join(word() for _ in range(70))
    long = " ".join(word() for _ in range(6000))
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "one two"), (5, "One  two"), (6, "a" * 1000), (7, "ab " * 400), (8, long), (9, long), (10, long + " end")]
    for k in range(20, 60):
        words = passage.split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = word()
        rows.append((k, " ".join(words[rng.randrange(3) :])))
    rows += [(k, f"{word()} {word()}\n{passage}\n{word()} x{k}") for k in range(60, 70)]
    rows += [(k, "tied tied tied tied\ntied tied tied tied") for k in range(70, 75)]
    return rows


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def clashing(df):
    from pyspark.sql import functions as F

    for name in CLASHING:
        df = df.withColumn(name, F.lit("own"))
    return df


def plain_words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def components(rows, size: int = 4, percent: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id to (n-grams, smallest doc_id reachable by links) by comparing all that share a first n-gram."""
    sets = {}
    for i, text in rows:
        w = plain_words(text)
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    frequency = Counter(g for s in sets.values() for g in s)
    lists, root = defaultdict(list), {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        ordered = sorted(sets[i], key=lambda g: (frequency[g], g))
        near = set()
        for g in ordered[: len(ordered) - math.ceil(percent * len(ordered) / 100) + 1]:
            near.update(lists[g])
            lists[g].append(i)
        for j in near:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def without_repeats(rows, length: int = 100) -> dict[int, tuple]:
    """doc_id to (bytes, removed, spans, digest of the rest) by a set of all strings seen."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - length + 1):
            string = data[p : p + length]
            if string in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(string)
        spans = sum(1 for k, c in enumerate(covered) if c and not (k and covered[k - 1]))
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        out[i] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def leaks(rows, items, threshold: float = 0.8, size: int = 5) -> dict[tuple[int, int], tuple[int, float]]:
    """(doc_id, item_id) to (first word, similarity) of the best window, trying every window of every document."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, text in rows:
        doc = words(text)
        for item, item_text in items:
            wanted = words(item_text)
            if not wanted or not doc:
                continue
            n = min(size, len(wanted))
            bag = lambda w: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))  # noqa: B023, E731
            own, wide = bag(wanted), min(len(wanted), len(doc))
            if wide < n:
                continue
            best = (-1.0, 0)
            for first in range(len(doc) - wide + 1):
                window = bag(doc[first : first + wide])
                both = (own & window).total()
                best = max(best, (both / (own.total() + window.total() - both), -first))
            if best[0] >= threshold:
                out[i, item] = (-best[1], best[0])
    return out


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def chats(seed: int, conversations: int = 120) -> list[tuple]:
    """Messages that quote lines, runs of lines, paragraphs or all of earlier ones, of any conversation or of none."""
    rng = random.Random(seed)
    word = lambda: rng.choice(("alpha", "beta", "gamma", "delta", "no", "yes", "line", "Ärger"))
    line = lambda: " ".join(word() for _ in range(rng.randrange(1, 7)))
    rows: list[tuple] = []
    bodies: list[tuple[int, int, str]] = []
    for c in range(conversations):
        for t in range(rng.choice((1, 4, 30))):
            body = "\n".join(rng.choice((line(), line(), line(), "", "  ", "Thanks a lot!")) for _ in range(rng.randrange(6)))
            parts = []
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                near = [b for b in bodies if b[0] == c] if rng.random() < 0.7 else bodies
                said = rng.choice(near)[2].split("\n") if near and rng.random() < 0.85 else [line(), line()]
                a, b = sorted((rng.randrange(len(said) + 1), rng.randrange(len(said) + 1)))
                marks = rng.choice(("> ", ">", ">> ", " > > "))
                head = rng.choice(("", "", "Ann wrote:\n", "On Monday, Bob wrote:\n\n", "---- Original Message ----\n"))
                parts.append(head + "\n".join(marks + rng.choice((x, x.upper(), x + "  ")) for x in said[a:b]))
                parts.append(line())
            text = "\n".join([*parts, body])
            rows.append((c, t * rng.choice((1, 1, 2)) if rng.random() < 0.05 else t, rng.choice(("user", "assistant", None)), rng.choice((text, text, text, text.replace("\n", "\r\n")))))
            bodies.append((c, t, text))
    rows += rng.sample(rows, 30)
    rows += [(None, 1, "user", "x"), (3, None, "user", "x"), (3, 900, "user", None), (3, 901, None, ""), (3, 901, "user", "tie")]
    rng.shuffle(rows)
    return rows


def formatted(rows: list[tuple]) -> list[tuple]:
    """What format_chats gives, message by message, by comparing every passage with everything said."""
    first = lambda r: (r[2] is not None, r[2] or "", r[3] or "")
    known: dict[tuple[int, int], tuple[str | None, str]] = {}
    for r in sorted((r for r in rows if None not in r[:2]), key=first, reverse=True):
        known[r[0], r[1]] = (r[2], r[3] or "")
    normal = lambda t: re.sub(r"[\s\u00a0]+", " ", t.lower()).strip(" ")
    parsed, said = {}, defaultdict(set)
    for key, (_, text) in known.items():
        lines = []  # raw, depth, words, passage
        for raw in text.split("\n"):
            m = re.match(r"[ \t]*((?:>[ \t]?)+)", raw)
            lines.append([raw, m[1].count(">") if m else 0, normal(raw[m.end() :] if m else raw), None])
        passages: list[tuple[int, list[str]]] = []
        for k, (_, depth, words, _) in enumerate(lines):
            if depth and words:
                if not k or lines[k - 1][1] != depth or not lines[k - 1][2]:
                    passages.append((depth, []))
                passages[-1][1].append(words)
                lines[k][3] = len(passages) - 1
            elif depth:
                lines[k][3] = -1
        for k, (raw, depth, _, _) in enumerate(lines):
            behind = [x for x in lines[k + 1 :] if x[2]]
            later = [x[3] for x in behind if x[1]]
            if not depth and later:
                direct = behind[0][1] and re.match(r"(?i)[^\S\n]*(?:on\s.{1,200}\s(?:wrote|said|writes)|.{1,120}\s(?:wrote|writes))\s*:?\s*$", raw)
                if direct or re.match(r"(?i)\s*-{2,}\s*original message\s*-{2,}\s*:?\s*$", raw):
                    lines[k][3] = later[0]
        parsed[key] = (lines, [(d, " ".join(w)) for d, w in passages])
        own = [x[0] for x in lines if not x[1] and x[3] is None]
        spoken = [w for w in map(normal, own) if w]
        said[key] = {" ".join(spoken[i:j]) for i in range(len(spoken)) for j in range(i + 1, len(spoken) + 1)} | {normal(p) for p in re.split(r"\n\s*\n", "\n".join(own))}
    out, parents, cited = [], {}, {}
    for (c, t), (_, passages) in parsed.items():
        links = []
        for depth, words in passages:
            holders = sorted(k for k in said if words in said[k]) if len(words) >= 8 else []
            near = [k for k in holders if k[0] == c and k[1] < t]
            links.append((depth, near[-1] if near else next((k for k in holders if k[0] != c), None)))
        cited[c, t] = links
        inner = [(d, p, k[1]) for p, (d, k) in enumerate(links) if k and k[0] == c]
        if inner:
            parents[c, t] = min(inner)[2]
    for (c, t), (role, text) in known.items():
        lines, passages = parsed[c, t]
        links = cited[c, t]
        linked = {p for p, (_, k) in enumerate(links) if k}
        if linked:
            text = "\n".join(x[0] for x in lines if x[3] is None or (x[3] >= 0 and x[3] not in linked))
            text = re.sub(r"^(?:[^\S\n]*\n)+|(?:\n[^\S\n]*)+\Z", "", text)
        best = min(((d, p, k) for p, (d, k) in enumerate(links) if k), default=(0, 0, (None, None)))[2]
        root = t
        while (c, root) in parents:
            root = parents[c, root]
        out.append([c, t, 0, root, role, text, parents.get((c, t)), *best, len(links), len(linked)])
    place: Counter = Counter()
    for row in sorted(out, key=lambda r: (r[0], r[3], r[1])):
        row[2] = place[row[0]]
        place[row[0]] += 1
    return sorted(map(tuple, out), key=lambda r: r[:2])


def feistel(key: bytes, tag: str, x: int, n: int, rounds: int = 10) -> int:
    """A balanced network over pairs of digits to the base of the root of n, walked until below n."""
    secret = hashlib.blake2b(key, digest_size=32).digest()
    base = math.isqrt(n - 1) + 1
    label = hashlib.blake2b(f"{tag}:{n}".encode(), digest_size=16).digest()
    while True:
        pair = [x // base, x % base]
        for r in range(rounds):
            need = (base.bit_length() + 7) // 8 + 8
            raw = pair[1].to_bytes(max(1, (pair[1].bit_length() + 7) // 8), "little")
            stream = b"".join(hashlib.blake2b(raw, digest_size=64, key=secret, salt=bytes([r, i]), person=label).digest() for i in range(-(-need // 64)))
            pair = [pair[1], (pair[0] + int.from_bytes(stream[:need], "little") % base) % base]
        x = pair[0] * base + pair[1]
        if x < n:
            return x


def with_pseudonyms(key: bytes, text: str | None) -> str | None:
    """Cards of 16 digits that pass their check, and dates with the year first, replaced."""

    def card(m: re.Match) -> str:
        check = lambda s: -sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in s[::-1])) % 10
        if check(m[0][:15]) != int(m[0][15]):
            return m[0]
        head = f"{feistel(key, 'card:' + '0' * 15, int(m[0][:15]), 10**15):015d}"
        return head + str(check(head))

    def day(m: re.Match) -> str:
        first = datetime.date(1900, 1, 1)
        old = datetime.date.fromisoformat(m[0])
        x = (old - first).days
        while True:
            x = feistel(key, "date", x, (datetime.date(2100, 1, 1) - first).days)
            new = first + datetime.timedelta(x)
            if (new.day > 12) == (old.day > 12):
                return new.isoformat()

    return None if text is None else re.sub(r"\d{4}-\d\d-\d\d", day, re.sub(r"\b\d{16}\b", card, text))


def plain_logit(net, text: bytes) -> float:
    """The network's answer by loops: filters over all bytes of each chunk of two blocks, strongest answers, dense layers, mean."""
    width, block = len(net.filters), 256
    blocks = max(1, -(-(len(text) + width - 1) // block))
    data = text + bytes(blocks * block - len(text))
    answers = [sum(net.filters[p, data[i + p]].astype(float) for p in range(width)) for i in range(len(data) - width + 1)]
    out = []
    for k in range(max(1, blocks - 1)):
        stop = min((k + 2) * block, len(answers))
        best = [max(a[f] for a in answers[k * block : stop]) for f in range(net.filters.shape[2])]
        seen = [max(0.0, b + float(c)) for b, c in zip(best, net.bias, strict=True)] + [min(max(len(text) - k * block, 0), 2 * block) / (2 * block)]
        hidden = [max(0.0, sum(s * float(w) for s, w in zip(seen, net.dense[:, h], strict=True)) + float(net.dense_bias[h])) for h in range(net.dense.shape[1])]
        out.append(sum(h * float(w) for h, w in zip(hidden, net.out, strict=True)) + float(net.out_bias[0]))
    return sum(out) / len(out)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def spelling_counts(rows, noise: int = 199, least: int = 6, times: int = 5) -> dict[str, int]:
    counts: Counter = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= times}


def spelling(counts: dict[str, int], ratio: int = 5) -> dict[str, tuple]:
    """word to (form, root, n, n_near, form_n), by comparing all pairs of similar length."""
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    near = {w: [x for n in (-1, 0, 1) for x in by_length[len(w) + n] if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def lexical(rows, items, k: int = 10) -> set[tuple]:
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(terms(t))) for i, t in rows if i is not None and terms(t)]
    total, many = sum(sum(c.values()) for _, c in docs), len(docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = set()
    for i, own in asked.items():
        scored = []
        for d, c in docs:
            m = 100 - 90 + 90 * sum(c.values()) * many // total
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, d))
        out |= {(i, rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k])}
    return out
