"""Language ID of web pages by Bayesian evidence fusion.

Evidence, combined as independent given the language:
- the main text: a multinomial over hashed byte trigrams, learned from all
  pages under their declared language; its log likelihood is scaled to that of
  EFFECTIVE trigrams at most, since the trigrams of a text are not independent;
- the declared markup language and the address suffix (top-level domain and a
  two-letter first path segment): how often each goes with each language,
  counted over all pages with the text's own posterior as weight, every value
  with a likelihood of its own;
- the host: a prior smoothed towards its domain's, which is smoothed towards its
  top-level domain's and that towards the prior of all, by grouped sums. A page
  doesn't count towards its own host's prior.

Every declared code is a language, however rare. The text model is held for
AT_ONCE languages at a time, with one more pass over the texts for every further
AT_ONCE; what is kept for each host or value is joined, not collected.

Defined results: a page without text, markup language or url loses just that
evidence; with no declared language anywhere there are no languages, and lang is
null; ties go to the first language in alphabetical order; repeated rows each
get a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.templates import main_text
from logloom.llm.textvec import LOWER, chunks, utf8
from logloom.llm.urlfilter import url_host, url_path
from logloom.tables import drop_materialized, materialize, ship, tidy

BUCKETS = 1 << 14
#: Languages whose text model is in memory at once: 128 KiB each.
AT_ONCE = 256
#: Each value of a kind of evidence is smoothed by 0.5; with more values than these, all share what so many have.
SMOOTHED = 500
EFFECTIVE = 60
ALPHA = 5.0
#: Host priors are broadcast up to so many hosts, and any table up to so many numbers; with more values, pages are dealt by value and salt.
BROADCAST_HOSTS, BROADCAST_NUMBERS, SALT = 50_000, 3_200_000, 32

_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", re.I)


def suffix(url: Column) -> Column:
    """`com/en` for http://a.example.com/en/x: the top-level domain, and the first path segment if it has two letters."""
    top = F.regexp_extract(url_host(url), r"([^.]*)$", 1)
    return F.concat_ws("/", top, F.lower(F.regexp_extract(url_path(url), r"^/([a-zA-Z]{2})(?:/|$)", 1)))


def _read():
    """(page_id, url, host, suffix, html) -> the same with declared and text instead of html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared, texts = [], []
            for page in batch.column("html").to_pylist():
                m = _LANG.search(page or "")
                declared.append(m[1].lower() if m else None)
                texts.append(main_text(page or ""))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host", "suffix")), pa.array(declared, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "host", "suffix", "declared", "text"])

    return run


def trigrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams that lie within a text, and bounds by text."""
    x = LOWER[data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    g = ((x[:-2] | x[1:-1] << 8 | x[2:] << 16) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
    room = np.maximum(np.diff(offsets) - 2, 0)
    bounds = np.concatenate([[0], np.cumsum(room)])
    at = np.arange(bounds[-1]) + np.repeat(offsets[:-1] - bounds[:-1], room)
    return g[at].astype(np.int64), bounds


def _count(langs: list[str]):
    """(declared, text) -> (lang, bucket, n) summed within a task, as far as AT_ONCE languages go."""

    def rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        found = [(x, np.flatnonzero(row)) for x, row in total.items()]
        lang = np.concatenate([np.full(len(b), x, np.int32) for x, b in found] or [np.zeros(0, np.int32)])
        bucket = np.concatenate([b for _, b in found] or [np.zeros(0, np.int64)]).astype(np.int32)
        n = np.concatenate([total[x][b] for x, b in found] or [np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(n)], ["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(langs)}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lang = [number.get(x, -1) for x in batch.column("declared").to_pylist()]
            offsets, data = utf8(batch.column("text"))
            for i, j, o, d in chunks(offsets, data):
                g, bounds = trigrams(o, d)
                pages: dict[int, list[np.ndarray]] = {}
                for r in range(j - i):
                    if lang[i + r] >= 0:
                        pages.setdefault(lang[i + r], []).append(g[bounds[r] : bounds[r + 1]])
                for x, parts in pages.items():
                    n = np.bincount(np.concatenate(parts), minlength=BUCKETS)
                    total[x] = total[x] + n if x in total else n
                    if len(total) >= AT_ONCE:
                        yield rows(total)
                        total = {}
        yield rows(total)

    return run


def _text_likelihood(model, last: bool):
    """Adds to the list ll the log likelihoods of the text under the languages of the model; the last one drops the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = model.value
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            out = np.zeros((batch.num_rows, len(logp)))
            for i, j, o, d in chunks(offsets, data):
                g, bounds = trigrams(o, d)
                some = np.flatnonzero(np.diff(bounds))
                n = np.diff(bounds)[some]
                for x, row in enumerate(logp):
                    if len(some):
                        out[i + some, x] = np.add.reduceat(row[g], bounds[:-1][some]) * np.minimum(1, EFFECTIVE / n)
            if "ll" in batch.schema.names:
                out = np.hstack([batch.column("ll").flatten().to_numpy().reshape(batch.num_rows, -1), out])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            names = [c for c in batch.schema.names if c != "ll" and not (last and c == "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], [*names, "ll"])

    return run


def _with_likelihood(rows: DataFrame, langs: list[str], columns: str) -> DataFrame:
    """rows(columns, text) with ll instead of text, AT_ONCE languages in a pass over the texts."""
    counts = materialize(rows.select("declared", "text").mapInArrow(tidy(_count(langs)), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    for i in range(0, len(langs), AT_ONCE):
        here, last = langs[i : i + AT_ONCE], i + AT_ONCE >= len(langs)
        found = counts.where(F.col("lang").between(i, i + len(here) - 1)).toArrow()
        total = np.full((len(here), BUCKETS), 0.1)
        total[found.column("lang").to_numpy() - i, found.column("bucket").to_numpy()] += found.column("n").to_numpy()
        model = rows.sparkSession.sparkContext.broadcast(np.log(total / total.sum(1, keepdims=True)))
        out = rows.mapInArrow(tidy(_text_likelihood(model, last)), f"{columns}, {'' if last else 'text string, '}ll array<double>")
        if not last:
            out = materialize(out)
            if i:
                drop_materialized(rows)
        rows = out
    return rows


def softmax(ll: Column) -> Column:
    e = F.transform(ll, lambda x: F.exp(x - F.array_max(ll)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """by, and the array s of the sums of p over its rows."""
    sums = rows.select(*by, F.posexplode("p").alias("i", "x")).groupBy(*by, "i").agg(F.sum("x").alias("x"))
    return sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).withColumn("s", F.col("s.x"))


def _literal(values) -> Column:
    """An array of doubles as one literal, however long."""
    return F.split(F.lit(",".join(repr(float(x)) for x in values)), ",").cast("array<double>")


def _smooth(own: Column, prior: Column) -> Column:
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, prior, lambda a, q: (F.greatest(a, F.lit(0.0)) + ALPHA * q) / (F.greatest(total, F.lit(0.0)) + ALPHA))


def _with_table(joined: DataFrame, seen: DataFrame, by: str, n: int) -> DataFrame:
    """joined with _by: the log probability of its value of a column given each language, zeros where it has none."""
    sums = materialize(_sums(seen.where(F.col(by).isNotNull()), by))
    values = sums.count()
    each = 0.5 * min(1, SMOOTHED / max(values, 1))
    whole = {r.i: r.x for r in sums.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()}  # one row for each language
    whole = _literal([whole.get(i, 0.0) + each * values + 1 for i in range(n)])
    table = sums.select(F.col(by).alias("_value"), F.zip_with("s", whole, lambda x, w: F.ln((x + F.lit(each)) / w)).alias(f"_{by}"))
    if values * n <= BROADCAST_NUMBERS:
        out = joined.join(F.broadcast(table), F.col(by) == F.col("_value"), "left")
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        out = joined.withColumn("_s", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
        out = out.join(salted, (F.col(by) == F.col("_value")) & (F.col("_s") == F.col("_salt")), "left").drop("_s", "_salt")
    return out.drop("_value").withColumn(f"_{by}", F.coalesce(f"_{by}", F.array_repeat(F.lit(0.0), n)))


def identify(pages: DataFrame) -> DataFrame:
    """(page_id, lang, posterior, declared, text_lang) for every row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    ship(spark)
    id_type = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), F.when(F.col("url").contains("://"), suffix(F.col("url"))).alias("suffix"), "html")
    rows = materialize(rows.mapInArrow(tidy(_read()), f"page_id {id_type}, url string, host string, suffix string, declared string, text string"))
    langs = sorted(r.declared for r in rows.where("declared IS NOT NULL").select("declared").distinct().collect())  # codes of two or three letters: 18,252 at most
    if not langs:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), "declared", F.lit(None).cast("string").alias("text_lang"))
    n = len(langs)
    seen = _with_likelihood(rows, langs, f"page_id {id_type}, url string, host string, suffix string, declared string")
    seen = materialize(seen.withColumn("p", softmax(F.col("ll"))).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)))

    hosts = materialize(_sums(seen, "host", "domain"))
    rolled = hosts.select("domain", F.col("s").alias("p"))
    tops = rolled.withColumn("top", F.regexp_extract("domain", r"([^.]*)$", 1))
    tops = materialize(_sums(tops, "top"))
    everywhere = {r.i: r.x for r in tops.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()}  # one row for each language
    everywhere = np.array([everywhere.get(i, 0.0) for i in range(n)]) + 1.0
    tops = tops.select("top", _smooth(F.col("s"), _literal(everywhere / everywhere.sum())).alias("q_top"))
    domains = _sums(rolled, "domain").withColumn("top", F.regexp_extract("domain", r"([^.]*)$", 1)).join(tops, "top").select("domain", _smooth(F.col("s"), F.col("q_top")).alias("q_domain"))
    priors = hosts.join(domains, "domain").select(F.col("host").alias("_host"), "s", "q_domain")
    few = hosts.count()
    if few <= BROADCAST_HOSTS and few * n <= BROADCAST_NUMBERS:
        priors = F.broadcast(priors)
    joined = seen.join(priors, F.col("host") == F.col("_host"), "left")
    without_own = F.zip_with("s", "p", lambda a, b: a - b)
    host_prior = _smooth(without_own, F.col("q_domain"))
    joined = joined.withColumn("_prior", F.transform(host_prior, lambda x: F.ln(x)))
    joined = _with_table(_with_table(joined, seen, "declared", n), seen, "suffix", n)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    joined = joined.withColumn("_score", plus(plus(F.col("ll"), F.col("_prior")), plus(F.col("_declared"), F.col("_suffix"))))
    joined = joined.withColumn("_post", softmax(F.col("_score")))
    names = F.split(F.lit(",".join(langs)), ",")
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return joined.select("page_id", best(F.col("_post")).alias("lang"), F.array_max("_post").alias("posterior"), "declared", F.when(F.array_max("ll") < 0, best(F.col("p"))).alias("text_lang"))
