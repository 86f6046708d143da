"""Registered queries over the test tables, each with independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import bits, display, paths, text
from tallyfold.operators import actions, cache, exact, groups, member_tiles, pairs, selection, tools, word_join
from tallyfold.operators.components import FEW_EDGES, connected_components
from tallyfold.operators.filters import filter_files, has_extension, remaining
from tallyfold.plans.options import ScanOptions
from tallyfold.plans.storage import write_table
from tallyfold.sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW, RADIUS = 1_700_100_000, 18

# --- SQL building blocks -------------------------------------------------------------------------

FD = r"""fd AS (SELECT doc_id AS scan_seq,
  CASE WHEN doc_id % 17 = 0 THEN '/corpus/Temp/' ELSE '/corpus/' END || source || '/' || lang || '/' || CASE WHEN doc_id % 23 = 0 THEN '~$' ELSE '' END
    || 'doc_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.tmp' WHEN 3 THEN '.html' ELSE '' END AS path,
  CAST(octet_length(encode(text)) AS BIGINT) AS size, 1700000000 + (doc_id * 7919) % 100000 AS modified,
  CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1700000000 + (doc_id * 7919) % 100000 - (doc_id % 7) * 3600 END AS created, sha256(text) AS full_hash, text FROM documents)"""
EX = FD + """, ex AS (SELECT *, min(scan_seq) OVER (PARTITION BY size, full_hash) AS group_id FROM fd QUALIFY count(*) OVER (PARTITION BY size, full_hash) > 1)"""
KEEP_SQL = {"oldest": "modified, path, scan_seq", "newest": "modified DESC, path, scan_seq", "largest": "size DESC, path, scan_seq", "first": "scan_seq"}


def _rk(strategy: str = "oldest") -> str:
    return EX + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {KEEP_SQL[strategy]}) - 1 AS pos FROM ex)"""


PG = "pg AS (SELECT page_id AS scan_seq, url AS path, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages)"
WORDS = r"regexp_extract_all(lower({}), '[a-z0-9]+|[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}]')"
RATIO = "CASE WHEN a.size = 0 OR b.size = 0 THEN a.size = b.size ELSE greatest(a.size, b.size) <= 4 * least(a.size, b.size) END"


def _score_sql(a: str, b: str) -> str:
    """Greedy one-to-one word matches as a reduction."""
    at = """CASE WHEN coalesce(list_position(s.rem, e.x), 0) > 0 THEN list_position(s.rem, e.x)
                 WHEN length(e.x) >= 2 THEN coalesce(list_position(list_transform(s.rem, lambda y: length(y) >= 2 AND levenshtein(e.x, y) <= 1), true), 0) ELSE 0 END"""
    step = f"""list_transform([{at}], lambda i: {{'x': e.x, 'n': s.n + CAST(i > 0 AS INT), 'rem': list_transform(s.rem, lambda y, j: CASE WHEN j = i THEN '' ELSE y END)}})[1]"""
    start = f"[{{'x': '', 'n': 0, 'rem': {b}}}] || list_transform({a}, lambda w: {{'x': w, 'n': 0, 'rem': CAST([] AS VARCHAR[])}})"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST(2.0 AS DOUBLE) * list_reduce({start}, lambda s, e: {step}).n / (len({a}) + len({b})) END"


def _groups_sql(pairs_cte: str) -> str:
    """(scan_seq, group_id) of the components of p (src, dst)."""
    return f"""WITH RECURSIVE {pairs_cte}, e AS (SELECT src AS x, dst AS y FROM p UNION ALL SELECT dst, src FROM p),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
SELECT x AS scan_seq, least(x, min(y)) AS group_id FROM reach GROUP BY x"""


def query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# --- exact duplicates ----------------------------------------------------------------------------

_SUMMARY = "SELECT group_id, count(*) AS n_files, max(CASE WHEN pos = 0 THEN size END) AS file_size, CAST(sum(size) - max(CASE WHEN pos = 0 THEN size END) AS BIGINT) AS reclaimable, max(CASE WHEN pos = 0 THEN path END) AS keeper FROM rk GROUP BY group_id"


def _members(spark: SparkSession, d: str) -> DataFrame:
    """The contents are read and hashed once; what is joined and ranked are the short rows."""
    return exact.exact_members(write_table(t.files_docs(spark, d), "hashed"))


def _summary(strategy: str) -> Callable:
    return lambda spark, d: groups.by_gain(exact.exact_summary(t.files_docs(spark, d), strategy)).drop("kind")


for _name, _strategy in (("exact_groups", "oldest"), ("exact_keep_newest", "newest"), ("exact_keep_largest", "largest"), ("exact_keep_first", "first")):
    query(_name, f"WITH {_rk(_strategy)} {_SUMMARY}")(_summary(_strategy))


@query("exact_members", f"WITH {_rk()} SELECT group_id, path, size, modified, created, pos FROM rk")
def _(spark, d):
    return groups.ranked(_members(spark, d)).select("group_id", "path", "size", "modified", "created", F.col("pos").cast("bigint").alias("pos"))


@query("size_candidates", f"WITH {FD} SELECT size, count(*) AS n FROM fd GROUP BY size HAVING count(*) > 1")
def _(spark, d):
    return exact.repeated(t.files_docs(spark, d), "size")


@query(
    "partial_hash_groups",
    f"""WITH {FD}, b AS (SELECT size, encode(text) AS c FROM fd),
h AS (SELECT size, CASE WHEN size < 4096 THEN md5(c) ELSE md5(encode(CAST(size AS VARCHAR) || ':') || c[1:256] || c[-256:]) END AS h FROM b)
SELECT size, count(*) AS n FROM h GROUP BY size, h HAVING count(*) > 1""",
)
def _(spark, d):
    f = t.files_docs(spark, d, content=True)
    return exact.repeated(f.select("size", exact.partial_hash(F.col("size"), F.col("content"), 4096, 256).alias("partial_hash")), "size", "partial_hash").select("size", "n")


@query("remaining_files", f"WITH {EX} SELECT scan_seq, path FROM fd WHERE path NOT IN (SELECT path FROM ex)")
def _(spark, d):
    hashed = write_table(t.files_docs(spark, d), "hashed")
    return remaining(hashed, exact.exact_members(hashed)).select("scan_seq", "path")


# --- filters and expressions ---------------------------------------------------------------------

_EXT = r"CASE WHEN regexp_matches(regexp_extract(path, '[^/\\]*$'), '^.+\.[^.]*$') THEN lower(regexp_extract(path, '\.([^./\\]*)$', 1)) END"
for _name, _options, _where in (
    ("filter_size_range", {"min_size": 500, "max_size": 3000}, "size >= 500 AND size <= 3000"),
    ("filter_only_ext", {"only_extensions": ("txt", "MD")}, f"coalesce({_EXT} IN ('txt', 'md'), false)"),
    ("filter_exclude_ext", {"exclude_extensions": ("tmp",)}, f"NOT coalesce({_EXT} IN ('tmp'), false)"),
    ("filter_exclude_path", {"exclude_paths": ("/Temp/", "src1")}, "NOT contains(path, '/Temp/') AND NOT contains(path, 'src1')"),
):
    query(_name, f"WITH {FD} SELECT path, size FROM fd WHERE {_where}")(lambda spark, d, o=_options: filter_files(t.files_docs(spark, d), ScanOptions(**o)).select("path", "size"))


@query(
    "path_parts",
    rf"""WITH {PG}, b AS (SELECT *, regexp_extract(path, '[^/\\]*$') AS name FROM pg)
SELECT path, regexp_extract(path, '^(.*)[/\\]', 1) AS dir, name, lower(name) AS low, {_EXT} AS ext, CASE WHEN name = '' THEN path ELSE name END AS file_name,
  CAST(length(path) - length(regexp_replace(path, '[/\\]', '', 'g')) AS INT) AS depth,
  CASE WHEN regexp_matches(CASE WHEN name = '' THEN path ELSE name END, '^.+\.[^.]+$') THEN upper(regexp_extract(CASE WHEN name = '' THEN path ELSE name END, '\.([^.]+)$', 1)) ELSE '文件' END AS type FROM b""",
)
def _(spark, d):
    p = F.col("path")
    return t.pages_names(spark, d).select(
        "path", paths.parent_dir(p).alias("dir"), paths.base_name(p).alias("name"), paths.lower_name(p).alias("low"), paths.extension(p).alias("ext"), paths.file_name(p).alias("file_name"),
        paths.path_depth(p).alias("depth"), paths.file_type(p).alias("type"),
    )


@query(
    "display_formats",
    f"""WITH {FD}, s AS (SELECT path, size * k AS n, modified FROM fd, (VALUES (1), (1000), (1000000)) v(k))
SELECT path, n, CASE WHEN n < 1024 THEN n || ' B' ELSE (CASE WHEN n / v >= 100 THEN format('{{:.0f}}', floor(n / v + 0.5)) ELSE format('{{:.1f}}', floor(n / v * 10 + 0.5) / 10) END) || ' ' || u END AS shown, strftime(make_timestamp(modified * 1000000), '%Y-%m-%d %H:%M') AS date
FROM (SELECT *, CASE WHEN n >= 1024 ** 4 THEN 1024.0 ** 4 WHEN n >= 1024 ** 3 THEN 1024.0 ** 3 WHEN n >= 1024 ** 2 THEN 1024.0 ** 2 ELSE 1024.0 END AS v,
             CASE WHEN n >= 1024 ** 4 THEN 'TB' WHEN n >= 1024 ** 3 THEN 'GB' WHEN n >= 1024 ** 2 THEN 'MB' ELSE 'KB' END AS u FROM s)""",
)
def _(spark, d):
    rows = t.files_docs(spark, d).select("path", "modified", F.explode(F.array(*(F.col("size") * k for k in (1, 1000, 1_000_000)))).alias("n"))
    return rows.select("path", "n", display.format_bytes(F.col("n")).alias("shown"), display.format_date(F.col("modified")).alias("date"))


@query("tokenize_names", f"WITH {PG} SELECT path, unnest({WORDS.format('path')}) AS word, generate_subscripts({WORDS.format('path')}, 1) - 1 AS at FROM pg")
def _(spark, d):
    return t.pages_names(spark, d).select("path", F.posexplode(text.words(F.col("path"))).alias("at", "word")).withColumn("at", F.col("at").cast("bigint"))


# --- similarity ----------------------------------------------------------------------------------


def _name_pairs_sql(level: float, same_dir: bool) -> str:
    name, bucket = (r"regexp_extract(path, '[^/\\]*$')", r"regexp_extract(path, '^(.*)[/\\]', 1)") if same_dir else ("path", "''")
    return f"""{PG}, w AS (SELECT *, {WORDS.format(name)} AS ws, {bucket} AS bucket FROM pg),
c AS (SELECT a.scan_seq AS src, b.scan_seq AS dst, a.ws AS x, b.ws AS y FROM w a JOIN w b ON a.bucket = b.bucket AND a.scan_seq < b.scan_seq AND {RATIO}),
p AS (SELECT * FROM (SELECT src, dst, {_score_sql("x", "y")} AS score FROM c) WHERE score >= {level})"""


def _names(spark: SparkSession, d: str, same_dir: bool, join: Callable = pairs.name_links) -> DataFrame:
    return join(t.pages_names(spark, d), 60 if same_dir else 80, same_dir, None, None if same_dir else F.col("path"))


@query("fuzzy_pairs", f"WITH {_name_pairs_sql(0.8, False)} SELECT src, dst, score FROM p")
def _(spark, d):
    return _names(spark, d, False, pairs.name_pairs)


def _components(pair_rows: DataFrame) -> DataFrame:
    return connected_components(pair_rows, few=FEW_EDGES).select(F.col("node").alias("scan_seq"), F.col("component").alias("group_id"))


@query("fuzzy_groups_same_dir", _groups_sql(_name_pairs_sql(0.6, True)))
def _(spark, d):
    return _components(_names(spark, d, True))


@query("fuzzy_groups_global", _groups_sql(_name_pairs_sql(0.8, False)))
def _(spark, d):
    return _components(_names(spark, d, False))


@query(
    "fuzzy_exact_word_score",
    f"""WITH w AS (SELECT p_partkey AS k, p_type AS g, {WORDS.format("p_name")} AS ws FROM part),
x AS (SELECT k, word, count(*) AS n FROM (SELECT k, unnest(ws) AS word FROM w) GROUP BY ALL),
c AS (SELECT a.k AS src, b.k AS dst, sum(least(a.n, b.n)) AS common FROM x a JOIN x b USING (word) JOIN w p ON p.k = a.k JOIN w q ON q.k = b.k WHERE a.k < b.k AND p.g = q.g GROUP BY ALL)
SELECT src, dst, score FROM (SELECT src, dst, CAST(2.0 AS DOUBLE) * common / (len(p.ws) + len(q.ws)) AS score FROM c JOIN w p ON p.k = src JOIN w q ON q.k = dst) WHERE score >= 0.8""",
)
def _(spark, d):
    p = t.table(spark, d, "part").select(F.col("p_partkey").alias("scan_seq"), F.col("p_type").alias("bucket"), text.words(F.col("p_name")).alias("words"))
    lists, members = word_join.word_lists(p)
    scored = word_join.scored_lists(lists, 0.8, similar=False).where("score >= 0.8")
    return member_tiles.spelt_out(member_tiles.member_nodes(members.withColumn("size", F.lit(1).cast("bigint")), "id"), scored)


HASH_SQL = """eh AS (SELECT vec_id AS scan_seq, list_reduce([CAST(0 AS BIGINT)] || list_transform(ac, lambda v, i: CASE WHEN v > mean THEN CAST(1 AS BIGINT) << CAST(i - 1 AS BIGINT) ELSE 0 END), lambda x, y: x | y) AS phash
  FROM (SELECT *, list_reduce([CAST(0 AS DOUBLE)] || ac, lambda x, y: x + y) / 63.0 AS mean FROM (SELECT vec_id, CAST(embedding[2:64] AS DOUBLE[]) AS ac FROM embeddings)))"""


@query("phash_bits", f"WITH {HASH_SQL} SELECT scan_seq, phash FROM eh")
def _(spark, d):
    return t.emb_hashes(spark, d)


_HAMMING = f"""{HASH_SQL}, p AS (SELECT a.scan_seq AS src, b.scan_seq AS dst, CAST(bit_count(xor(a.phash, b.phash)) AS INT) AS distance FROM eh a JOIN eh b ON a.scan_seq < b.scan_seq AND bit_count(xor(a.phash, b.phash)) <= {RADIUS})"""


@query("hamming_pairs", f"WITH {_HAMMING} SELECT src, dst, distance FROM p")
def _(spark, d):
    return pairs.hash_pairs(t.emb_hashes(spark, d), RADIUS)


@query("image_groups", _groups_sql(_HAMMING))
def _(spark, d):
    return _components(pairs.hash_links(t.emb_hashes(spark, d), RADIUS))


_MUSIC = f"""s AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS dur, {WORDS.format("p_brand || ' ' || p_name")} AS ws FROM part),
c AS (SELECT a.k AS src, b.k AS dst, a.ws AS x, b.ws AS y, least(a.dur, b.dur) AS lo, greatest(a.dur, b.dur) AS hi FROM s a JOIN s b ON a.k < b.k AND (a.dur = 0 OR b.dur = 0 OR least(a.dur, b.dur) >= greatest(a.dur, b.dur) * 85 // 100)),
p AS (SELECT * FROM (SELECT src, dst, CAST(0.9 AS DOUBLE) * ({_score_sql("x", "y")}) + CAST(0.1 AS DOUBLE) * (CASE WHEN lo = 0 THEN 0.0 WHEN lo >= hi * 9 // 10 THEN 1.0 WHEN lo >= hi * 8 // 10 THEN 0.5 ELSE 0.0 END) AS score FROM c) WHERE score >= 0.8)"""


@query("music_pairs", f"WITH {_MUSIC} SELECT src, dst, score FROM p")
def _(spark, d):
    return pairs.music_pairs(t.part_songs(spark, d), 80)


@query("music_groups", _groups_sql(_MUSIC))
def _(spark, d):
    return _components(pairs.music_links(t.part_songs(spark, d), 80))


_VIDEOS = f"""{HASH_SQL}, v AS (SELECT 2 * (scan_seq // 20) + k AS scan_seq, list(phash ORDER BY scan_seq) AS sig FROM eh, (VALUES (0), (1)) t(k) WHERE scan_seq % 20 BETWEEN 5 * k AND 5 * k + 14 GROUP BY ALL)"""
_SHARE = "CAST(len(list_filter({0}, lambda p: len(list_filter({1}, lambda q: bit_count(xor(p, q)) <= " + str(RADIUS) + ")) > 0)) AS DOUBLE) / len({0})"
_VPAIRS = f"""{_VIDEOS.replace("2 * (scan_seq // 20) + k AS scan_seq", "2 * (scan_seq // 20) + k AS vid")},
p AS (SELECT * FROM (SELECT a.vid AS src, b.vid AS dst, ({_SHARE.format("a.sig", "b.sig")} + {_SHARE.format("b.sig", "a.sig")}) / 2.0 AS score FROM v a JOIN v b ON a.vid < b.vid) WHERE score >= 0.6)"""


@query("video_pairs", f"WITH {_VPAIRS} SELECT src, dst, score FROM p")
def _(spark, d):
    return pairs.video_pairs(t.emb_videos(spark, d), RADIUS)


@query("video_groups", _groups_sql(_VPAIRS))
def _(spark, d):
    return _components(pairs.video_links(t.emb_videos(spark, d), RADIUS))


@query("sig_roundtrip", f"""WITH {_VIDEOS.replace("2 * (scan_seq // 20) + k AS scan_seq", "2 * (scan_seq // 20) + k AS vid")} SELECT vid AS scan_seq, list_aggregate(list_transform(sig, lambda x: lpad(lower(to_hex(x)), 16, '0')), 'string_agg', ',') AS shown, true AS same FROM v""")
def _(spark, d):
    shown = t.emb_videos(spark, d).withColumn("shown", bits.signature_text(F.col("sig")))
    return shown.select("scan_seq", "shown", (bits.signature_of(F.col("shown")) == F.col("sig")).alias("same"))


# --- cleanup, totals, views ----------------------------------------------------------------------


@query("big_files_topn", f"WITH {FD} SELECT 'big_file' AS kind, path, size, modified, created, format('{{:.1f}} MB', size / 1048576.0) AS detail FROM fd WHERE size > 0 ORDER BY size DESC, scan_seq LIMIT 50")
def _(spark, d):
    return tools.big_files(t.files_docs(spark, d), 50)


@query(
    "temp_files",
    f"""WITH {FD}, x AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS name, {_EXT} AS ext, contains(path, '/Temp/') AS inside FROM fd)
SELECT 'temp_file' AS kind, path, size, modified, created, CASE WHEN starts_with(name, '~$') THEN 'Office 临时锁定文件' WHEN inside THEN '位于临时目录' ELSE '临时文件扩展名 .' || ext END AS detail
FROM x WHERE starts_with(name, '~$') OR inside OR coalesce(ext IN ('tmp', 'temp', 'crdownload', 'part', 'partial', 'download', 'swp', 'lock', 'dmp', 'bak~', 'cache'), false)""",
)
def _(spark, d):
    return tools.temp_files(t.files_docs(spark, d))


@query("empty_dirs", "SELECT DISTINCT '/corpus/' || source || '/void' AS path, 'empty_folder' AS kind FROM documents")
def _(spark, d):
    return tools.empty_folders(t.dirs(spark, d)).select("path", "kind")


@query("scan_summary", f"WITH {FD} SELECT count(*) AS scanned_files, CAST(sum(size) AS BIGINT) AS scanned_bytes FROM fd")
def _(spark, d):
    return groups.scan_totals(t.files_docs(spark, d))


@query("reclaimable_totals", f"WITH {_rk()}, s AS ({_SUMMARY}) SELECT count(*) AS n_groups, CAST(sum(reclaimable) AS BIGINT) AS reclaimable, CAST(sum(n_files - 1) AS BIGINT) AS n_copies FROM s")
def _(spark, d):
    return groups.totals(exact.exact_summary(t.files_docs(spark, d)))


@query("kind_totals", f"WITH {_rk()}, s AS ({_SUMMARY}) SELECT 'exact' AS kind, '精确重复' AS label, count(*) AS n_groups, CAST(sum(reclaimable) AS BIGINT) AS reclaimable FROM s")
def _(spark, d):
    got = groups.of_kind(exact.exact_summary(t.files_docs(spark, d)), "exact").groupBy("kind").agg(F.count("*").alias("n_groups"), F.sum("reclaimable").alias("reclaimable"))
    return got.withColumn("label", display.kind_label(F.col("kind")))


@query("flat_rows", f"WITH {_rk()} SELECT group_id, path, pos, pos = 0 AS is_ref, pos = 0 AS first_of_group, count(*) OVER (PARTITION BY group_id) AS span FROM rk")
def _(spark, d):
    return groups.flat_rows(_members(spark, d)).select("group_id", "path", F.col("pos").cast("bigint").alias("pos"), "is_ref", "first_of_group", "span")


# --- selection -----------------------------------------------------------------------------------


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return groups.ranked(_members(spark, d))


_CHECKED = ("group_id", "path", "checked")
_N, _D = r"regexp_extract(path, '[^/\\]*$')", r"length(regexp_replace(path, '[^/\\]', '', 'g'))"
_DAYS = (NOW // 86_400 - 1) * 86_400
_UNDER = "(lower(path) = '/corpus/src1' OR starts_with(lower(path), '/corpus/src1/') OR starts_with(lower(path), '/corpus/src1\\'))"
for _c, _v, _w in (
    ("name_ge", 14, f"length({_N}) >= 14"), ("name_le", 14, f"length({_N}) <= 14"), ("name_length_ge", 30, "length(path) >= 30"), ("name_length_le", 30, "length(path) <= 30"),
    ("depth_ge", 5, f"{_D} >= 5"), ("depth_le", 4, f"{_D} <= 4"), ("created_before", 1, f"created > 0 AND created < {_DAYS}"), ("created_after", 1, f"created > 0 AND created > {_DAYS}"),
    ("modified_before", 1, f"modified > 0 AND modified < {_DAYS}"), ("modified_after", 1, f"modified > 0 AND modified > {_DAYS}"),
    ("name_contains", "DOC_0000", f"contains(lower({_N}), 'doc_0000')"), ("name_not_contains", "DOC_0000", f"NOT contains(lower({_N}), 'doc_0000')"),
    ("path_under_dir", "/Corpus/src1", _UNDER), ("path_outside_dir", "/Corpus/src1", f"NOT {_UNDER}"),
):
    query(f"select_{_c}", f"WITH {_rk()} SELECT group_id, path, {_w} AS checked FROM rk")(lambda spark, d, c=_c, v=_v: selection.select_by(_rows(spark, d), c, v, NOW).select(*_CHECKED))
for _c, _o in (
    ("name_long", f"length({_N}) DESC"), ("name_short", f"length({_N})"), ("depth_deep", f"{_D} DESC"), ("depth_shallow", _D), ("created_new", "created DESC"), ("created_old", "created"),
    ("modified_new", "modified DESC"), ("modified_old", "modified"), ("path_long", "length(path) DESC"), ("path_short", "length(path)"),
):
    query(f"keep_{_c}", f"WITH {_rk()} SELECT group_id, path, row_number() OVER (PARTITION BY group_id ORDER BY {_o}, pos) > 1 AS checked FROM rk")(
        lambda spark, d, c=_c: selection.keep_by(_rows(spark, d), c).select(*_CHECKED)
    )
for _c, _w in (("path_under_dir", _UNDER), ("path_outside_dir", f"NOT {_UNDER}")):
    query(f"keep_{_c}", f"WITH {_rk()} SELECT group_id, path, bool_or({_w}) OVER (PARTITION BY group_id) AND NOT ({_w}) AS checked FROM rk")(
        lambda spark, d, c=_c: selection.keep_by(_rows(spark, d), c, "/Corpus/src1").select(*_CHECKED)
    )


@query("default_selection", f"WITH {_rk()} SELECT group_id, path, pos > 0 AS checked FROM rk")
def _(spark, d):
    return selection.default_selection(_rows(spark, d)).select(*_CHECKED)


@query("invert_selection", f"WITH {_rk()} SELECT group_id, path, pos = 0 AS checked FROM rk")
def _(spark, d):
    return selection.invert(selection.default_selection(_rows(spark, d))).select(*_CHECKED)


# --- cache and actions ---------------------------------------------------------------------------

_SC = FD + """, sc AS (SELECT path, size, CASE WHEN scan_seq % 2 = 0 THEN modified ELSE modified - 1 END AS mtime, substr(full_hash, 1, 32) AS partial_hash, full_hash, 1 AS scanned_at FROM fd WHERE scan_seq % 2 = 0 OR scan_seq % 6 = 1)"""


@query("cache_lookup", f"WITH {_SC} SELECT fd.path, sc.full_hash, sc.path IS NOT NULL AS hit FROM fd LEFT JOIN sc ON sc.path = fd.path AND sc.size = fd.size AND sc.mtime = fd.modified")
def _(spark, d):
    return cache.lookup(t.files_docs(spark, d).drop("full_hash"), t.scan_cache(spark, d), "full_hash").select("path", "full_hash", "hit")


@query(
    "cache_merge",
    f"""WITH {_SC}, nw AS (SELECT path, size, modified AS mtime, substr(full_hash, 1, 32) AS partial_hash, CAST(NULL AS VARCHAR) AS full_hash, 2 AS scanned_at FROM fd WHERE scan_seq % 3 <> 0)
SELECT coalesce(nw.path, sc.path) AS path, coalesce(nw.mtime, sc.mtime) AS mtime, CASE WHEN nw.path IS NULL THEN sc.full_hash WHEN sc.size = nw.size AND sc.mtime = nw.mtime THEN coalesce(nw.full_hash, sc.full_hash) ELSE nw.full_hash END AS full_hash,
  CAST(coalesce(nw.scanned_at, sc.scanned_at) AS BIGINT) AS scanned_at FROM nw FULL JOIN sc ON sc.path = nw.path""",
)
def _(spark, d):
    f = t.files_docs(spark, d).where("scan_seq % 3 <> 0")
    new = f.select("path", "size", F.col("modified").alias("mtime"), F.substring("full_hash", 1, 32).alias("partial_hash"), F.lit(None).cast("string").alias("full_hash"), F.lit(2).cast("bigint").alias("scanned_at"))
    return cache.merge(t.scan_cache(spark, d), new).select("path", "mtime", "full_hash", "scanned_at")


@query("cache_count", f"WITH {_SC} SELECT CAST(count(*) AS BIGINT) AS n_rows FROM sc")
def _(spark, d):
    return cache.row_count(t.scan_cache(spark, d))


@query(
    "action_plan",
    f"""WITH {_rk()}, k AS (SELECT group_id, max(CASE WHEN pos = 0 THEN path END) AS reference FROM rk GROUP BY group_id),
now AS (SELECT path, CASE WHEN scan_seq % 4 = 1 THEN size + 1 ELSE size END AS s, CASE WHEN scan_seq % 4 = 2 THEN modified + 1 ELSE modified END AS m FROM fd WHERE scan_seq % 4 <> 3)
SELECT rk.path, reference, 'hardlink' AS action, CASE WHEN now.path IS NULL THEN 'missing' WHEN s <> size THEN 'size changed' WHEN m <> modified THEN 'time changed' ELSE 'ready' END AS state
FROM rk JOIN k USING (group_id) LEFT JOIN now ON now.path = rk.path WHERE pos > 0""",
)
def _(spark, d):
    s = F.col("scan_seq") % 4
    now = t.files_docs(spark, d).where(s != 3).select("path", (F.col("size") + F.when(s == 1, 1).otherwise(0)).alias("size"), (F.col("modified") + F.when(s == 2, 1).otherwise(0)).alias("modified"))
    items = actions.gate(selection.checked_items(selection.default_selection(_rows(spark, d))), "hardlink")
    return actions.plan_actions(items, now, "hardlink").select("path", "reference", "action", "state")


@query("cache_hits", f"WITH {_SC} SELECT count(sc.path) AS cache_hits FROM fd LEFT JOIN sc ON sc.path = fd.path AND sc.size = fd.size AND sc.mtime = fd.modified")
def _(spark, d):
    return cache.hits(cache.lookup(t.files_docs(spark, d).drop("full_hash"), t.scan_cache(spark, d), "full_hash"))


# --- views and selections that no list above covers ----------------------------------------------


@query(
    "nested_groups",
    f"""WITH {_rk()}, s AS ({_SUMMARY}) SELECT s.group_id, 'exact' AS kind, s.file_size, s.reclaimable, rk.pos AS place, rk.path, rk.size FROM s JOIN rk USING (group_id)""",
)
def _(spark, d):
    rows = groups.nested(_members(spark, d))
    at = F.posexplode("files").alias("at", "f")
    return rows.select("group_id", "kind", "file_size", "reclaimable", "page", at).select("group_id", "kind", "file_size", "reclaimable", (F.col("at") + F.col("page") * groups.PAGE).cast("bigint").alias("place"), "f.path", "f.size")


_GONE = "(pos > 0 AND size % 2 = 0)"


@query(
    "after_delete",
    f"""WITH {_rk()}, l AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY group_id) AS n FROM rk WHERE NOT {_GONE})
SELECT group_id, path, place AS pos, place > 0 AS checked FROM l WHERE n > 1""",
)
def _(spark, d):
    rows = selection.default_selection(_rows(spark, d))
    done = rows.where("pos > 0").select("path", (F.col("size") % 2 == 0).alias("ok"))
    return selection.after_actions(rows, done, "delete").select("group_id", "path", F.col("pos").cast("bigint").alias("pos"), "checked")


@query("checked_count", f"WITH {_rk()} SELECT count(*) AS n_checked FROM rk WHERE pos > 0")
def _(spark, d):
    return selection.checked_count(selection.default_selection(_rows(spark, d)))


for _name, _change, _w in (
    ("select_all_visible", selection.select_all, "pos > 0 OR contains(path, '.txt')"), ("select_none_visible", selection.select_none, "pos > 0 AND NOT contains(path, '.txt')"),
    ("invert_visible", selection.invert, "CASE WHEN contains(path, '.txt') THEN pos = 0 ELSE pos > 0 END"),
):
    query(_name, f"WITH {_rk()} SELECT group_id, path, {_w} AS checked FROM rk")(
        lambda spark, d, f=_change: f(selection.default_selection(_rows(spark, d)), F.col("path").contains(".txt")).select(*_CHECKED)
    )


@query("toggle_first_group", f"WITH {_rk()} SELECT group_id, path, pos > 0 OR group_id = (SELECT min(group_id) FROM rk) AS checked FROM rk")
def _(spark, d):
    rows = selection.default_selection(_rows(spark, d))
    return selection.toggle_group(rows, rows.agg(F.min("group_id")).first()[0]).select(*_CHECKED)


@query("toggle_last_file", f"WITH {_rk()} SELECT group_id, path, (pos > 0) <> (path = (SELECT max(path) FROM rk)) AS checked FROM rk")
def _(spark, d):
    rows = selection.default_selection(_rows(spark, d))
    last = rows.agg(F.max_by(F.struct("group_id", "path"), "path")).first()[0]
    return selection.toggle_file(rows, last["group_id"], last["path"]).select(*_CHECKED)


@query("status_labels", f"WITH {_rk()} SELECT group_id, path, CASE WHEN pos > 0 THEN '删除' ELSE '保留' END AS status FROM rk")
def _(spark, d):
    return selection.default_selection(_rows(spark, d)).select("group_id", "path", display.status_label(F.col("checked")).alias("status"))


@query("tool_rows_of_kind", f"WITH {FD} SELECT '大文件' AS label, path, size FROM fd WHERE size > 0 ORDER BY size DESC, scan_seq LIMIT 50")
def _(spark, d):
    f = t.files_docs(spark, d)
    both = tools.big_files(f, 50).unionByName(tools.temp_files(f))
    return tools.tools_of_kind(both, "big_file").select(display.tool_label(F.col("kind")).alias("label"), "path", "size")


@query("hash_codec", f"WITH {FD} SELECT path, full_hash AS shown, 32 AS n_bytes FROM fd")
def _(spark, d):
    raw = t.files_docs(spark, d).select("path", bits.hash_of_hex(F.col("full_hash")).alias("raw"))
    return raw.select("path", bits.hash_hex(F.col("raw")).alias("shown"), F.octet_length("raw").alias("n_bytes"))


@query("files_of_type", f"WITH {FD} SELECT path FROM fd WHERE coalesce({_EXT} IN ('html', 'md'), false)")
def _(spark, d):
    return t.files_docs(spark, d).where(has_extension(F.col("path"), ("HTML", "md"))).select("path")


@query(
    "comparable_songs",
    """WITH s AS (SELECT p_partkey AS scan_seq, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS artist, CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE p_name END AS title FROM part)
SELECT scan_seq FROM s WHERE trim(coalesce(artist, '')) <> '' OR trim(title) <> ''""",
)
def _(spark, d):
    k = F.col("scan_seq")
    songs = t.part_songs(spark, d).withColumns({"artist": F.when(k % 3 > 0, F.col("artist")), "title": F.when(k % 2 == 0, "  ").otherwise(F.col("title"))})
    return songs.where(text.comparable_tag(F.col("artist"), F.col("title"))).select("scan_seq")


@query("action_sample", f"WITH {_rk()} SELECT group_id, path FROM rk WHERE pos > 0 ORDER BY group_id, pos LIMIT 5")
def _(spark, d):
    return actions.sample(selection.checked_items(selection.default_selection(_rows(spark, d)))).select("group_id", "path")
