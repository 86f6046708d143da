"""Language identification by Bayesian evidence fusion.

A multinomial model of hashed byte trigrams gives each text's log likelihood in each language and in
``und``, which is the uniform distribution; it counts as at most ``EVIDENCE`` independent trigrams. The
first-pass posteriors are then summed by grouped aggregation: by declared language, which gives the
probability of a declaration in each language, and by address suffix, site and host, each level smoothed
towards the one above. A row's own share is taken out of its own priors. The sum of the log evidence is
the final posterior.

The text model is fitted on at most ``SAMPLE`` labelled documents; every other count covers all rows. Null
and empty texts have no text evidence and follow declaration and host. Null or strange declarations and
null hosts are values like any other (``none``, ``other``, empty). Very long texts are read whole, but weigh as
much as EVIDENCE trigrams. Labels that contradict each other are not learned from.
Repeated rows get the same answer; ties go to the first language in order; an empty table gives an empty
result; a host with a third of all rows is one partial aggregate. Only the named columns are read, so others can't
clash, and ``keep_known`` hands them on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.columns import settled, small_batches
from tallyfold.llm.sampling import sampled_texts, without
from tallyfold.llm.url_filter import host_of, url_rest
from tallyfold.plans.storage import write_table

BUCKETS, SAMPLE, EVIDENCE, KAPPA, SLACK, LEAST = 1 << 16, 4000, 60, 8.0, 0.02, 0.5
UNKNOWN = "und"
_NUMBERED = re.compile(r"\S*\d\S*")
HTML_LANG = r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)"""
NOT_TEXT = r"(?is)<(script|style|nav|footer|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def _trigrams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of the words without digits, which say nothing of the language."""
    raw = np.frombuffer(f" {' '.join(_NUMBERED.sub(' ', (text or '').lower()).split())} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.empty(0, np.int64)
    three = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    return ((three * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def fit_text_model(labelled: DataFrame, text: str, label: str) -> tuple[list[str], np.ndarray]:
    """The languages in order and log probabilities [language, bucket]; of the sample's counts those that are not 0 reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(_trigrams(t), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    parts = labelled.where(F.col(label).isNotNull()).select(text, label).repartition(4).mapInArrow(counted, "lang string, bucket int, n bigint")
    rows = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(rows.column("lang").to_pylist(), object)
    langs = sorted(set(names))
    counts = np.zeros((len(langs), BUCKETS))
    counts[[langs.index(x) for x in names], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    smooth = counts + 0.5
    return langs, np.log(smooth / smooth.sum(axis=1, keepdims=True))


def _likelihoods(batches: Iterator[pa.RecordBatch], weights: np.ndarray, step: int = 128) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, step):
            batch = whole.slice(lo, step)
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                at = _trigrams(text)
                full = len(at) > 1
                out.append((weights[at].mean(axis=0) * min(len(at), EVIDENCE)).tolist() if full else [0.0] * weights.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "loglik"])


def _softmax(logs: Column) -> Column:
    return F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))


def _share(x: Column) -> Column:
    total = lambda: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return F.transform(x, lambda v: v / total())


def text_model(labelled: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """``fit_text_model`` on at most ``sample`` rows of ``labelled``."""
    marked = labelled.where(F.col(label).isNotNull()).select(key, F.col(label).cast("string").alias("label"))
    return fit_text_model(sampled_texts(labelled, marked, key, text, sample), "text", "label")


def host_sums(scored: DataFrame, n: int) -> DataFrame:
    """(host, suffix_sum, site_sum, host_sum): sums of the first posteriors of (host, site, suffix, first).

    Rows are added up by host alone; sites add up their hosts, and suffixes their sites. Each level is written, so
    a small one is broadcast by its size, and a suffix or host with most rows can be split where it is joined.
    """
    cells = [f"s{k}" for k in range(n)]
    first = [F.sum(F.get("first", F.lit(k))).alias(c) for k, c in enumerate(cells)]
    again = [F.sum(c).alias(c) for c in cells]
    hosts = write_table(scored.groupBy("host", "site", "suffix").agg(*first), "hosts")
    sites = write_table(hosts.groupBy("site", "suffix").agg(*again), "sites")
    suffixes = write_table(sites.groupBy("suffix").agg(*again), "suffixes")
    packed = lambda df, by: df.select(by, F.array(*cells).alias(f"{by}_sum"))
    placed = hosts.select("host", "site", "suffix", F.array(*cells).alias("host_sum")).join(packed(sites, "site"), "site").join(packed(suffixes, "suffix"), "suffix")
    return write_table(placed.select("host", "suffix_sum", "site_sum", "host_sum"), "places")


def identify(rows: DataFrame, key: str, text: Column, declared: Column, host: Column, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """key, declared, host, language, confidence and text_language for each row."""
    small_batches(rows.sparkSession)
    langs, logs = model
    langs = [*langs, UNKNOWN]
    weights = np.ascontiguousarray(np.vstack([logs, np.full((1, BUCKETS), -np.log(BUCKETS))]).T.astype(np.float32))
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # BUCKETS values a language
    said = F.lower(F.coalesce(declared, F.lit("")))
    said = F.when(said == "", "none").when(said.isin(langs[:-1]), said).otherwise("other")
    place = F.lower(F.coalesce(host, F.lit("")))
    base = rows.select(F.col(key).alias("id"), said.alias("said"), place.alias("host"), text.cast("string").alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    scored = base.mapInArrow(lambda it: _likelihoods(it, shared.value), f"id {kind}, said string, host string, loglik array<double>")
    scored = scored.withColumn("site", F.regexp_extract("host", r"([^.]+\.)?[^.]*$", 0)).withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0))
    scored = write_table(scored.withColumn("first", _share(_softmax(F.col("loglik")))), "likelihoods")
    n = len(langs)
    sums = [F.sum(F.get("first", F.lit(k))).alias(f"s{k}") for k in range(n)]
    # (langs + 2) rows at most, and one row.
    of_said = {r["said"]: r["said_sum"] for r in scored.groupBy("said").agg(F.array(*sums).alias("said_sum")).collect()}
    whole = [sum(c[k] or 0.0 for c in of_said.values()) for k in range(n)]
    values = [*langs[:-1], "none", "other"]
    given = {v: [float(np.log(((of_said.get(v) or [0.0] * n)[k] + SLACK * whole[k] / len(values) + 1e-3) / (whole[k] * (1 + SLACK) + 1e-3 * len(values)))) for k in range(n)] for v in values}
    spoken = F.create_map(*(x for v in values for x in (F.lit(v), F.array(*map(F.lit, given[v])))))
    top = [(w + 0.5) / (sum(whole) + 0.5 * n) for w in whole]
    joined = scored.join(host_sums(scored, n), "host")
    # A level's sum without the row's own share, smoothed by the level above.
    prior = F.array(*map(F.lit, top))
    for by in ("suffix", "site", "host"):
        rest = F.zip_with(F.col(f"{by}_sum"), F.col("first"), lambda s, f: F.greatest(s - f, F.lit(0.0)))
        name = f"{by}_prior"
        joined = joined.withColumn("rest", rest)
        mass = F.aggregate("rest", F.lit(0.0), lambda a, v: a + v)
        joined = joined.withColumn("mass", mass).withColumn(name, F.zip_with("rest", prior, lambda r, p: (r + F.lit(KAPPA) * p) / (F.col("mass") + F.lit(KAPPA))))
        prior = F.col(name)
    evidence = F.zip_with(F.zip_with("loglik", F.element_at(spoken, F.col("said")), lambda a, b: a + b), "host_prior", lambda a, p: a + F.log(p))
    joined = settled(settled(joined, "evidence", evidence), "post", _share(_softmax(F.col("evidence"))))
    pick = lambda name: F.element_at(F.array(*map(F.lit, langs)), F.array_position(name, F.array_max(name)).cast("int"))
    return joined.select(
        F.col("id").alias(key), F.col("said").alias("declared"), "host", pick("post").alias("language"), F.array_max("post").alias("confidence"),
        F.when(F.array_max("loglik") < 0, pick("loglik")).alias("text_language"),
    )


def page_languages(pages: DataFrame, model: tuple[list[str], np.ndarray], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``identify`` over html pages: markup declares the language, the url names the host."""
    seen = F.regexp_replace(F.col(html), NOT_TEXT, " ")
    return identify(pages, page_id, seen, F.regexp_extract(F.coalesce(F.col(html), F.lit("")), HTML_LANG, 1), host_of(url_rest(F.col(url))), model)


def document_languages(
    documents: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source"
) -> DataFrame:
    """``identify`` over documents: a column declares the language, the source stands for the host."""
    return identify(documents, doc_id, F.col(text), F.col(declared), F.col(host), model)


def accepted(least: float = LEAST) -> Column:
    """Whether a row's language is one of the model's, surely enough."""
    return (F.col("language") != UNKNOWN) & (F.col("confidence") >= least)


def keep_known(documents: DataFrame, doc_id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """The documents in a language of the model, with their columns; rows that share an id, or have none, are judged each by itself."""
    # The hash passes over nulls, so whether a value is null goes in beside it.
    same = F.xxhash64(*(x for c in ("text", "lang", "source") for x in (F.col(c), F.col(c).isNull())))
    marked = documents.withColumn("__tf_row", F.struct(F.col(doc_id).alias("id"), same.alias("same")))
    seen = document_languages(marked, text_model(documents, key=doc_id), "__tf_row").withColumn("kept", accepted(least))
    seen = seen.select(F.col("__tf_row.id").alias(doc_id), F.col("__tf_row.same").alias("__tf_same"), "kept")
    return without(documents, write_table(seen, "languages").where("NOT kept"), doc_id, same)
