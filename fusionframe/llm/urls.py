"""URL verdicts: host and path rules first, then a weighted vocabulary."""

from __future__ import annotations

import functools

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_but, load

#: (verdict, host, path prefix)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Terms that reject alone, and terms of which two distinct ones reject.
STRICT = ("porn", "porno", "pornos", "pornografia", "pornographie", "xxx", "hentai", "escort", "escorts", "camgirl", "camgirls", "milf",
          "viagra", "cialis", "casino", "casinos", "kasino", "spielhalle", "putas", "nutten", "warez", "keygen")
SOFT = ("adult", "adulto", "adultos", "adulte", "adultes", "erotik", "erotic", "erotica", "sex", "sexe", "sexo", "nude", "nudes", "nackt",
        "desnuda", "bet", "bets", "wetten", "apuestas", "paris-sportifs", "poker", "slots", "pills", "pillen", "pastillas", "pilules",
        "cheap", "billig", "barato", "loan", "kredit", "prestamo", "dating", "citas", "rencontres", "hot", "free", "gratis", "gratuit",
        "torrent", "torrents", "crack", "cracked", "serial")


@functools.lru_cache(maxsize=8)
def _automaton(strict: tuple, soft: tuple):
    auto = ahocorasick.Automaton()
    for term in soft:
        auto.add_word(term, (term, False))
    for term in strict:
        auto.add_word(term, (term, True))
    auto.make_automaton()
    return auto


def term_hits(url: str | None, strict: tuple, soft: tuple) -> tuple[int, int]:
    """Distinct strict and soft terms that stand between characters other than letters and digits (or the ends)."""
    text = (url or "").lower()
    found = {True: set(), False: set()}
    for end, (term, is_strict) in _automaton(strict, soft).iter(text):
        start = end - len(term) + 1
        if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
            found[is_strict].add(term)
    return len(found[True]), len(found[False])


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = 2) -> DataFrame:
    """Add host, path, rule and verdict to rows with a `url`.

    The longest fitting rule decides; without one, the vocabulary does: one strict
    term or `soft_limit` distinct soft terms block. A null url has no terms: allow. Columns with the
    names of the new ones are replaced. The vocabulary (English, German, Spanish, French) is an argument.
    """
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("strict int, soft int")
    def hits(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([term_hits(u, strict, soft) for u in urls], columns=["strict", "soft"])

    url, own = F.col("_page").getField("url"), ("host", "path", "rule", "verdict", "strict_hits", "soft_hits")
    rule = verdict = None
    for kind, host, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(prefix)
        rule = F.when(fits, host + prefix) if rule is None else rule.when(fits, host + prefix)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    blocked = (F.col("_hits.strict") > 0) | (F.col("_hits.soft") >= soft_limit)
    method = F.when(blocked, "block").otherwise("allow")
    return (
        pages.select(F.struct(*all_but(pages, *own)).alias("_page"), hits("url").alias("_hits"))
        .select("_page", "_hits", host_of(url).alias("host"), path_of(url).alias("path"))
        .select("_page.*", "host", "path", (rule if rule is not None else F.lit(None).cast("string")).alias("rule"),
                (F.coalesce(verdict, method) if verdict is not None else method).alias("verdict"),
                F.col("_hits.strict").alias("strict_hits"), F.col("_hits.soft").alias("soft_hits"))
    )


def op4_url_vocabulary(spark, sf_dir) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")
