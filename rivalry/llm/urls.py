"""URL filter: host and path rules first, then a weighted vocabulary found with Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The vocabulary. A strict term weighs as much as SOFT_HITS soft ones: one of these as a whole term rejects a url.
STRICT = (
    "adult", "bdsm", "blackjack", "botnet", "camgirl", "camgirls", "casino", "casinos", "cialis", "erotic", "escort", "escorts", "fetish",
    "hardcore", "hentai", "keygen", "keylogger", "malware", "milf", "nsfw", "nude", "nudes", "onlyfans", "phishing", "porn", "porno",
    "pornstar", "ransomware", "roulette", "sex", "sexcam", "sexcams", "spyware", "stripper", "trojan", "viagra", "warez", "webcam", "xxx",
)
#: So many different ones of these reject a url.
SOFT = (
    "ads", "affiliate", "banner", "bet", "bets", "betting", "bonus", "cash", "cheap", "click", "clicks", "coupon", "crack",
    "credit", "dating", "deal", "deals", "discount", "earn", "farm", "forex", "free", "gamble", "girls", "hack", "hot", "jackpot",
    "keno", "loan", "loans", "lottery", "lucky", "money", "offer", "payday", "pills", "poker", "popup", "prize", "promo", "rich", "singles",
    "slot", "slots", "spam", "torrent", "track", "tracker", "tracking", "weightloss", "win", "winner",
)
SOFT_HITS = 2

#: (host, path, verdict)
Rule = tuple[str, str, str]


def host_and_path(url_col) -> tuple:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: from there up to '?', '#' or the end."""
    at = F.instr(url_col, "://")
    rest = F.when(at > 0, F.substring(url_col, at + 3, F.length(url_col))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host, path, rules: Iterable[Rule]):
    """The longest rule that fits, as a struct (rule, verdict), or null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(
            fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(out)
    return out


def term_counts(strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT):
    """A pandas UDF: (strict hits, distinct strict, distinct soft) of a text, by Aho-Corasick with boundary checks.

    A term counts where no letter a-z and no digit stands beside it; A-Z counts as lower case.
    """
    strict, soft = tuple(strict), tuple(soft)
    weights = {t: 0 for t in soft} | {t: 1 for t in strict}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

    def scan(batches):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, heavy in weights.items():
            found.add_word(term, (term, heavy))
        if weights:
            found.make_automaton()
        for batch in batches:
            hard, light = [], []
            for text in batch.column("terms_of").to_pylist():
                text = (text or "").translate(lower)
                hits: tuple[set, set] = (set(), set())
                for end, (term, heavy) in found.iter(text) if weights else ():
                    start = end + 1 - len(term)
                    if (start == 0 or text[start - 1] not in word) and (end + 1 == len(text) or text[end + 1] not in word):
                        hits[heavy].add(term)
                hard.append(len(hits[1]))
                light.append(len(hits[0]))
            keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "terms_of"]
            names = [n for n in batch.schema.names if n != "terms_of"]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(hard, pa.int32()), pa.array(light, pa.int32())], [*names, "n_strict", "n_soft"]
            )

    return scan


def judge_urls(
    pages: DataFrame,
    rules: Iterable[Rule] = (),
    strict: Iterable[str] = STRICT,
    soft: Iterable[str] = SOFT,
    soft_hits: int = SOFT_HITS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row (page_id, host, path, rule, verdict, n_strict, n_soft) per input row; no shuffle.

    A fitting rule decides (the longest one). Else the url is blocked on one strict term, or on `soft_hits`
    different soft terms, anywhere in it. A null url, or one without '://', has an empty host and path; a
    null or empty one is allowed, any other is judged by its terms. Very long urls are scanned whole; of
    rules of one length the one that is listed last wins; repeated rows give repeated results; null ids are
    kept; other columns, whatever their names, are not read; an empty table gives no rows.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = urls.select("page_id", host.alias("host"), path.alias("path"), F.col("url").alias("terms_of"))
    kind = dict(rows.dtypes)["page_id"]
    rows = rows.mapInArrow(
        term_counts(strict, soft), f"page_id {kind}, host string, path string, n_strict int, n_soft int"
    )
    ruled = rule_for(F.col("host"), F.col("path"), rules)
    found = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_hits), "block").otherwise("allow")
    return rows.withColumn("ruled", ruled).select(
        "page_id", "host", "path", F.col("ruled.rule").alias("rule"),
        F.coalesce("ruled.verdict", found).alias("verdict"), "n_strict", "n_soft",
    )
