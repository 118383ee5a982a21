"""Defaults, times, paths, digests and classifications of single fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms with their numbers in the tables of submissions; the last is for unknown names.
FORMS = {"job_interest_form": (40, 61, "d7c7277", "61"), "contact_form": (34, 129, "7f7b520", "129"), "product_demo_form": (34, 129, "7f7b520", "129"), "consult_form": (34, 129, "7f7b520", "129")}
JOB_FORM, *_, DEFAULT_FORM = FORMS


def non_blank(text: Column) -> Column:
    """The text, or null if it is blank."""
    return F.when(F.length(F.trim(text)) > 0, text)


def trim_to(text: Column, size: int, default: str = "") -> Column:
    """Trimmed to at most size characters; blank gives the default."""
    return F.coalesce(F.substring(F.trim(non_blank(text)), 1, size), F.lit(default))


def form_name(text: Column) -> Column:
    """A known form's name, trimmed; anything else, another case too, is the default form."""
    name = F.trim(text)
    return F.when(name.isin(list(FORMS)), name).otherwise(F.lit(DEFAULT_FORM))


def iran_time(utc: Column) -> Column:
    return F.from_utc_timestamp(utc, "Asia/Tehran")


def expiry(stated: Column, now: Column, minutes: int = 30) -> Column:
    """A stated time if it is valid and still ahead, else some minutes from now."""
    later = now + F.expr(f"interval {minutes} minutes")
    return F.when(stated > now, stated).otherwise(later)


def stated_expiry(json: Column, name: str, now: Column, zone: str = "Asia/Tehran", minutes: int = 30) -> Column:
    """The local time in a field of a JSON text as UTC; what is missing, no time or not ahead gives some minutes from now."""
    return expiry(F.to_utc_timestamp(F.try_to_timestamp(non_blank(json_field(json, name))), zone), now, minutes)


def as_json(**named: Column) -> Column:
    """A JSON object of the named columns; nulls are left out."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in named.items()]))


def ymd(date: Column) -> Column:
    return F.date_format(date, "yyyy/MM/dd")


def may_access(groups: Column, allowed: tuple[str, ...], admin: str = "admin") -> Column:
    """Whether a user of these groups is an administrator or in an allowed group."""
    return F.coalesce(F.arrays_overlap(groups, F.array(*map(F.lit, (admin, *allowed)))), F.lit(False))


def json_field(json: Column, name: str) -> Column:
    """A top-level field by name, whatever its case."""
    fields = F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: F.lower(k) == name.lower())
    return F.get(F.map_values(fields), F.lit(0))


def cache_key(text: Column, version: int = 0) -> Column:
    """Version and upper-case SHA-256 of the text."""
    return F.concat(F.lit(f"{version}:"), F.upper(F.sha2(text, 256)))


def joined_parts(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: F.length(F.trim(p)) > 0), "\n")


def url_path(url: Column) -> Column:
    """Lower-case path with one leading slash, without query and fragment; fragments, tel: and mailto: give ''."""
    bare = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    path = F.regexp_replace(F.regexp_replace(bare, r"^[a-z][a-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"^/+", ""), r"/+$", ""))
    return F.when(bare.rlike(r"^(#|tel:|mailto:|$)"), F.lit("")).otherwise(path)


def classify(title: Column, rules: list[tuple[str, tuple[str, ...]]], default: str, given: Column | None = None) -> Column:
    """The given class if not blank, else the first rule with a keyword in the title, else the default."""
    low = F.lower(title)
    out = F.when(non_blank(given).isNotNull(), given) if given is not None else None
    for name, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default))


def by_position(place: Column, names: tuple[str, ...], default: str) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), place), F.lit(default))


def page_title(site: str, *fields: Column) -> Column:
    """The first field that is not blank, and the site's name unless it holds it."""
    title = F.coalesce(*map(non_blank, fields), F.lit(site))
    return F.when(F.contains(title, F.lit(site)), title).otherwise(F.concat(title, F.lit(f" | {site}")))


def level_priority(level: Column) -> Column:
    return F.when(level <= 1, 1.0).when(level == 2, 0.8).otherwise(0.6)


def clamped(value: Column, low: float, high: float, default: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(default))))


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def insert_before_body_end(html: Column, tag: str) -> Column:
    """A tag before the last closing body tag, or at the end; a page that has it stays."""
    at = F.regexp_replace(html, r"(?is)^(.*)(</body\s*>)", "$1" + tag.replace("$", r"\$") + "$2")
    return F.when(html.contains(tag), html).when(html.rlike(r"(?i)</body\s*>"), at).otherwise(F.concat(html, F.lit(tag)))
