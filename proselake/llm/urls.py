"""URL filters: host and path rules, and for the rest a naive Bayes score over host words from Viterbi segmentation.

Concatenated host names are split into the most probable sequence of words under a unigram model of the words of all
pages. A multinomial naive Bayes classifier over host words and path tokens learns from every page that a rule judges,
and judges the pages without a rule.

The most frequent words and tokens come by broadcasts of bounded size, all others by joins, so all that was counted
has its weight.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.llm.shared import batches, hot_join, least_count, settle, table

#: (host, path, verdict); the longest rule that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words of the unigram model in a broadcast: the most frequent ones, at most LONGEST letters each, so at most 2.4 MB.
VOCABULARY, LONGEST = 100_000, 24
#: Tokens of the classifier in a broadcast: the most frequent ones. At most 100,000 * 64 characters; longer ones are hashed.
FEATURES, FEATURE_LENGTH = 100_000, 64

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url; both empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate(_FOLD), path


def rule_of(host: str, path: str, rules=RULES) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict."""
    fit = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def _short(run: str) -> str:
    """A path token, or the hash of a long one; no token holds the sign before it."""
    return run if len(run) <= FEATURE_LENGTH - 2 else "~" + hashlib.blake2b(run.encode(), digest_size=16).hexdigest()


class Segmenter:
    """The most probable split of a run of letters; an unknown letter alone costs as much as ten rare words."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = 10 * math.log(total + 1)
        self.split = lru_cache(maxsize=100_000)(self._split)

    def _split(self, run: str, rare: tuple[tuple[str, int], ...] = ()) -> tuple[str, ...]:
        """The words of a run; `rare` has the counts of further words that may stand in it."""
        best, back = [0.0], [0]
        more = {w: -math.log(n / self.total) for w, n in rare}
        for end in range(1, len(run) + 1):
            options = [(best[i] + c, i) for i in range(max(0, end - LONGEST), end) if (c := self.cost.get(run[i:end], more.get(run[i:end]))) is not None]
            cost, i = min(options, default=(math.inf, 0))
            alone = best[end - 1] + self.unknown
            best.append(min(cost, alone))
            back.append(i if cost <= alone else end - 1)
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return tuple(reversed(out))

    def tokens(self, host: str, path: str, rare: tuple[tuple[str, int], ...] = ()) -> list[str]:
        """Host words and path tokens; numbers count as one token, and host tokens differ from path tokens."""
        out = []
        for run in re.findall("[^\\W\\d_]+|\\d+", host):
            out += ["h:" + w for w in (("#",) if run[0].isdigit() else self.split(run, rare))]
        out += ["p:" + ("#" if run[0].isdigit() else _short(run)) for run in re.findall("[^\\W\\d_]+|\\d+", path.lower())]
        return out


def unigrams(pages: DataFrame) -> DataFrame:
    """(word, n) over the visible text of all pages: every word of a-z that may be part of a host name."""
    visible = F.regexp_replace(F.lower(F.coalesce("html", F.lit(""))), "<[^>]*>", " ")
    words = pages.select(F.explode(F.split(visible, "[^a-z]+")).alias("word")).where((F.length("word") > 1) & (F.length("word") <= LONGEST))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _substrings(it):
    """All strings within the letters of a host that may be words."""
    for batch in it:
        hosts, words = [], []
        for host in batch.column("host").to_pylist():
            found = {run[i:j] for run in re.findall("[a-z]+", host) for i in range(len(run)) for j in range(i + 2, min(i + LONGEST, len(run)) + 1)}
            hosts += [host] * len(found)
            words += found
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(words, pa.string())], ["host", "word"])


def _host(url) -> Column:
    """As `parts`, within the row."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _with_rare(source: DataFrame, rare: DataFrame) -> DataFrame:
    """`source` with the words of `rare`, and their counts, that may stand in the host of each page."""
    hosts = settle(source.groupBy("host").agg(F.count("*").alias("c")), "hosts")
    subs = hosts.select("host").mapInArrow(_substrings, "host string, word string")
    lists = subs.join(rare, "word").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("rare"))
    lists = settle(hosts.join(lists, "host", "left"), "lists")
    return hot_join(source, lists, ["host"], "c").select("page_id", "url", "rid", "rare")


def _tokenised(held, rules):
    split: list[Segmenter] = []

    def run(it):
        if not split:
            split.append(Segmenter(*held.value))
        for batch in it:
            rows = []
            for url, rare in zip(batch.column("url").to_pylist(), batch.column("rare").to_pylist(), strict=True):
                host, path = parts(url)
                rows.append((host, path, *rule_of(host, path, rules), split[0].tokens(host, path, tuple((x["word"], x["n"]) for x in rare or ()))))
            cols = [pa.array([r[i] for r in rows], pa.string()) for i in range(4)] + [pa.array([r[4] for r in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("rid"), *cols], ["page_id", "rid", "host", "path", "rule", "verdict", "tokens"])

    return run


def _scored(model):
    def run(it):
        block, allow, base, unseen = model.value
        for batch in it:
            out = []
            for verdict, tokens, more in zip(*(batch.column(n).to_pylist() for n in ("verdict", "tokens", "more")), strict=True):
                if verdict is None:
                    score = base + sum(block.get(t, unseen[0]) - allow.get(t, unseen[1]) for t in tokens) + (more or 0.0)
                    verdict = "block" if score > 0 else "allow"
                out.append(verdict)
            keep = ["page_id", "host", "path", "rule"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(out, pa.string())], [*keep, "verdict"])

    return run


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    Null urls and urls without ``://`` have an empty host and path and no rule; the classifier judges them by its prior.
    With no judged page at all every page is allowed. A tie is allowed. Repeated rows get equal verdicts. An empty table
    gives no rows. Urls and texts count whole, however long. Columns other than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    batches(spark)
    words = settle(unigrams(pages), "words")
    known = words.agg(F.sum("n"), F.count("*")).first()
    frequent = F.col("n") >= least_count(words, "n", VOCABULARY)
    common = words.where(frequent).collect()  # VOCABULARY rows at most
    held = spark.sparkContext.broadcast(({r["word"]: r["n"] for r in common}, known[0] or 0))
    # ids are kept in files before they are used
    source = settle(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _host("url").alias("host")).withColumn("rid", F.monotonically_increasing_id()), "urls")
    if known[1] > len(common):
        source = _with_rare(source, words.where(~frequent))
    else:
        source = source.drop("host").withColumn("rare", F.lit(None).cast("array<struct<word:string,n:bigint>>"))
    seen = settle(source.mapInArrow(_tokenised(held, rules), "page_id long, rid long, host string, path string, rule string, verdict string, tokens array<string>"), "pages")
    taught = seen.where("verdict is not null")
    prior = {r["verdict"]: r["n"] for r in taught.groupBy("verdict").agg(F.count("*").alias("n")).collect()}  # two rows
    by_token = settle(taught.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count_if(F.col("verdict") == "block").alias("block"), F.count_if(F.col("verdict") == "allow").alias("allow")
    ).withColumn("n", F.col("block") + F.col("allow")), "tokens")
    sums = by_token.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    total, size = (sums[0] or 0, sums[1] or 0), (sums[2] or 0) + 1
    frequent = F.col("n") >= least_count(by_token, "n", FEATURES)
    top = by_token.where(frequent).collect()  # FEATURES rows at most
    log = [{r["token"]: math.log((r[side] + 1) / (total[i] + size)) for r in top} for i, side in enumerate(("block", "allow"))]
    base = math.log((prior.get("block", 0) + 1) / (prior.get("allow", 0) + 1)) if prior else -1.0
    unseen = tuple(math.log(1 / (t + size)) for t in total)
    model = spark.sparkContext.broadcast((*log, base, unseen))
    if size - 1 > len(top):
        # what a counted token adds to an unseen one; summed in order, so that equal pages get equal scores
        gain = by_token.where(~frequent).select("token", (F.log(F.col("block") + 1.0) - F.log(F.col("allow") + 1.0)).alias("gain"))
        asked = seen.where("verdict is null").select("rid", F.explode("tokens").alias("token"))
        sums = asked.join(gain, "token").groupBy("rid").agg(F.aggregate(F.array_sort(F.collect_list("gain")), F.lit(0.0), lambda a, x: a + x).alias("more"))
        seen = seen.join(sums, "rid", "left")
    else:
        seen = seen.withColumn("more", F.lit(None).cast("double"))
    return seen.mapInArrow(_scored(model), "page_id long, host string, path string, rule string, verdict string")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
