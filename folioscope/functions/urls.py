"""URL columns: canonical form, allowlist, citation check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_URL = r"^(?i)([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user, port and www; empty where there is none."""
    bare = F.regexp_replace(F.regexp_extract(F.trim(url), _URL, 2), r"^.*@|:\d*$", "")
    return F.regexp_replace(F.lower(bare), r"^www\.", "")


def path(url: Column) -> Column:
    """Path with single slashes and no slash at its end."""
    p = F.regexp_replace(F.regexp_extract(F.trim(url), _URL, 3), "/+", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def canonical(url: Column, allowed_host: str | None = None) -> Column:
    """https, host without www, clean path, no port, query or fragment; null for what is no absolute URL or has another host."""
    ok = host(url) != ""
    if allowed_host is not None:
        ok = ok & (host(url) == allowed_host)
    return F.when(ok, F.concat(F.lit("https://"), host(url), path(url)))


def lenient(url: Column, allowed_host: str | None = None) -> Column:
    """canonical, or else trimmed lower case without slashes at the end."""
    return F.coalesce(canonical(url, allowed_host), F.lower(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", "")))


def compare_form(url: Column) -> Column:
    """For comparing labels: no slash at the end, no www, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", ""), r"(?i)://www\.", "://"))


def slug(url: Column) -> Column:
    """Last part of the path."""
    return F.element_at(F.split(path(url), "/"), -1)


def slug_mentions(text: Column, prefix: str) -> Column:
    """All slugs after the prefix (host and folder) in free text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(prefix.replace(".", r"\.") + "([a-z0-9-]+)"), F.lit(1))


def file_key(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("_"))


def fullwidth_form(url: Column, site: str) -> Column:
    """Full-width # and / as ASCII, and https:// before a bare site; apply text.nfkc before for all of NFKC."""
    t = F.translate(F.trim(F.coalesce(url, F.lit(""))), "＃／", "#/")
    return F.when(F.startswith(t, F.lit(site)), F.concat(F.lit("https://"), t)).otherwise(t)


def citation_check(url: Column, allowed: Column, site: str) -> Column:
    """(ok, url, code): allowed is an array of canonical URLs."""
    canon = canonical(fullwidth_form(url, site), site)
    ok = F.coalesce(F.array_contains(allowed, canon), F.lit(False))
    return F.struct(
        ok.alias("ok"),
        F.when(ok, canon).otherwise(fullwidth_form(url, site)).alias("url"),
        F.when(ok, "").otherwise("citation_not_allowlisted").alias("code"),
    )


def keep_allowed(df: DataFrame, url_col: str, allowed: DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose canonical URL is in allowed(url), or with negate those whose isn't; nulls aren't. Spark picks a broadcast by size."""
    kind = "left_anti" if negate else "left_semi"
    return df.join(allowed.select(F.col("url").alias("__allowed")), canonical(df[url_col]) == F.col("__allowed"), kind)
