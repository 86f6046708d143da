from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.functions import text
from tallyfold.operators import actions, cache, exact, groups, pairs, selection, tiles, tools, word_join
from tallyfold.operators.components import connected_components
from tallyfold.operators.filters import filter_files
from tallyfold.plans.options import ScanOptions

FILE = "path string, size bigint, modified bigint, created bigint, scan_seq bigint"


def files(spark, rows):
    return spark.createDataFrame([(p, s, m, 0, i) for i, (p, s, m) in enumerate(rows)], FILE)


def union_find(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 40)]
    rows = [*edges, (None, 1), (5, None), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "src bigint, dst bigint")).collect()}
    want = union_find((a, b) for a, b in edges if a != b)
    assert got == want


@pytest.mark.parametrize("few", [1, 10**6])
def test_components_in_memory(spark, monkeypatch, few):
    """Components are those of the rounds, from the first edges or from what a round leaves; edges in strips."""
    from tallyfold.operators import components

    monkeypatch.setattr(components, "STRIP", 7)
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(300 - i, 301 - i) for i in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 1), (5, None)], "src bigint, dst bigint"), few=few).collect()}
    assert got == union_find((a, b) for a, b in edges if a != b)
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint"), few=few).count() == 0


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_hash_pairs_equal_nested_loop(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 12).tolist()
    h = base + [b ^ int(sum(1 << int(i) for i in rng.choice(62, k, replace=False))) for b in base for k in (1, 5, 10, 11, 18)] + base[:2]
    df = spark.createDataFrame(list(enumerate(h)), "scan_seq bigint, phash bigint")
    for radius in (0, 2, 10, 18):
        got = [tuple(r) for r in pairs.hash_pairs(df, radius).collect()]
        want = [(i, j, (h[i] ^ h[j]).bit_count()) for i in range(len(h)) for j in range(i + 1, len(h)) if (h[i] ^ h[j]).bit_count() <= radius]
        assert sorted(got) == want


def test_name_pairs_equal_nested_loop(spark):
    from tests.test_functions import score_spec, words_spec

    rng = np.random.default_rng(4)
    stems = ["report", "reports", "copy", "final", "v1", "v2", "a", "b", "txt", "tx"]
    rows = [(f"/d{rng.integers(2)}/" + "_".join(rng.choice(stems, rng.integers(1, 5))) + ".txt", int(rng.integers(0, 9)), 0) for _ in range(60)]
    for threshold in (60, 80, 100):
        got = sorted((r["src"], r["dst"]) for r in pairs.name_pairs(files(spark, rows), threshold).collect())
        want = []
        for i, (p, s, _) in enumerate(rows):
            for j in range(i + 1, len(rows)):
                q, t, _ = rows[j]
                if p.rsplit("/", 1)[0] == q.rsplit("/", 1)[0] and (s == t if 0 in (s, t) else max(s, t) <= 4 * min(s, t)):
                    if score_spec(words_spec(p.rsplit("/", 1)[1]), words_spec(q.rsplit("/", 1)[1]), True) >= threshold / 100:
                        want.append((i, j))
        assert got == want


def test_fuzzy_case_and_bucket_limit(spark):
    f = files(spark, [("/d/report.txt", 5, 0), ("/d/report copy.txt", 5, 0), ("/d/report final.txt", 5, 0), ("/d/unrelated.txt", 5, 0)])
    parts = connected_components(pairs.name_pairs(f, 60)).collect()
    assert {r["node"] for r in parts} == {0, 1, 2}
    assert pairs.name_pairs(f, 60, max_bucket=3).count() == 0


def test_large_folders_are_compared(spark, caplog):
    f = files(spark, [(f"/d/{'abcdefghijklmnop'[i % 16]}{i * 7919 + 10**6}.txt", 5 ** (i % 9), 0) for i in range(3000)] + [("/d/quarterly report.txt", 5, 0), ("/d/report quarterly.txt", 5, 0)])
    assert ScanOptions().max_bucket is None
    assert (3000, 3001) in {(r["src"], r["dst"]) for r in pairs.name_pairs(f, 90, max_bucket=ScanOptions().max_bucket).collect()}
    assert not caplog.records and pairs.name_pairs(f, 90, max_bucket=3000).count() == 0
    assert "3002 files in 1 folders" in caplog.text


def test_music(spark):
    rows = [(0, "周杰伦", "晴天", 269), (1, "周杰伦", "晴天", 269), (2, "林俊杰", "江南", 300)]
    got = pairs.music_pairs(spark.createDataFrame(rows, "scan_seq bigint, artist string, title string, duration bigint"), 80).collect()
    assert [(r["src"], r["dst"]) for r in got] == [(0, 1)] and got[0]["score"] > 0.9


def test_songs_of_all_parts_equal_nested_loop(spark, tmp_path):
    from tallyfold import catalog
    from tests.test_functions import score_spec, words_spec

    rng = np.random.default_rng(6)
    brand, name = ["Brand#1", "Brand#12", "Brand#13"], ["red rod", "rod red", "old bolt", "cold bolt", "red", ""]
    rows = [(int(k), str(rng.choice(name)), str(rng.choice(brand)), int(rng.integers(0, 12))) for k in (0, 1, 399, 400, 401, *range(19_930, 20_000))]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    fits = lambda a, b: 0 in (a, b) or min(a, b) >= max(a, b) * 85 // 100
    time = lambda a, b: 0.0 if 0 in (a, b) else 1.0 if min(a, b) >= max(a, b) * 9 // 10 else 0.5 if min(a, b) >= max(a, b) * 8 // 10 else 0.0
    want = {}
    for i, (k, n, b, t) in enumerate(rows):
        for l, m, c, u in rows[i + 1 :]:
            score = 0.9 * score_spec(words_spec(f"{b} {n}"), words_spec(f"{c} {m}"), True) + 0.1 * time(t, u)
            if fits(t, u) and score >= 0.8:
                want[k, l] = score
    got = catalog.QUERIES["music_pairs"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["src"], r["dst"]): r["score"] for r in got} == pytest.approx(want)
    groups_of = {r["scan_seq"]: r["group_id"] for r in catalog.QUERIES["music_groups"](spark, str(tmp_path)).collect()}
    assert groups_of == union_find(want) and max(groups_of) > 400


def shuffled_names(rng, n):
    """Names of few words, of which some stand in every name."""
    stems = ["report", "reports", "copy", "final", "v1", "v2", "a", "b", "tx"]
    return ["example_" + "_".join(rng.choice(stems, rng.integers(1, 5))) + ".example.txt" for _ in range(n)]


@pytest.mark.parametrize("threshold", [20, 60, 80])
def test_common_words_lose_no_pair(spark, threshold):
    from tests.test_functions import score_spec, words_spec

    rng = np.random.default_rng(threshold)
    rows = [(f"/d/{n}", int(rng.integers(0, 40)), 0) for n in shuffled_names(rng, 50)]
    want = {}
    for i, (p, s, _) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            q, t, _ = rows[j]
            score = score_spec(words_spec(p[3:]), words_spec(q[3:]), True)
            if (s == t if 0 in (s, t) else max(s, t) <= 4 * min(s, t)) and score >= threshold / 100:
                want[i, j] = score
    f = files(spark, rows)
    got = pairs.name_pairs(f, threshold).collect()
    assert len(got) == len(want) and {(r["src"], r["dst"]): r["score"] for r in got} == pytest.approx(want)
    parts = {r["node"]: r["component"] for r in connected_components(pairs.name_links(f, threshold)).collect()}
    assert parts == union_find(want)


def test_long_names_share_the_last_bit(spark):
    from tests.test_functions import score_spec

    rng = np.random.default_rng(3)
    lists = [[str(w) for w in rng.integers(100, 300, n)] for n in (80, 110, 110, 120)]
    lists += [lists[2][:60] + lists[1][60:], lists[3][::-1], lists[3][:90]]
    rows = [(f"/d/{' '.join(w)}", 5, 0) for w in lists]
    want = [(i, j) for i in range(len(lists)) for j in range(i + 1, len(lists)) if score_spec(lists[i], lists[j], True) >= 0.2]
    assert sorted((r["src"], r["dst"]) for r in pairs.name_pairs(files(spark, rows), 20).collect()) == want and want


def test_no_score_in_a_join(spark):
    f = files(spark, [(f"/d/example {k}.txt", 5, 0) for k in range(9)])
    plan = pairs.name_pairs(f, 80)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "levenshtein" in line]


def test_a_word_in_every_name_is_not_probed(spark):
    from tallyfold.operators.word_join import list_pairs

    rows = [(i, "", ["example", "net", f"w{i:05d}{i * 7919 % 10007}", f"{'abcdefghij'[i % 10]}{i * 31:06d}"]) for i in range(2000)]
    lists = spark.createDataFrame(rows, "id bigint, bucket string, words array<string>")
    assert list_pairs(lists, 0.8).count() < 2000


def test_copies_give_star_edges(spark):
    n = 10_000
    same = spark.range(n).select(F.col("id").alias("scan_seq"), F.lit(7).cast("bigint").alias("phash"))
    assert pairs.hash_links(same, 18).count() == n - 1
    names = spark.range(n).select(F.col("id").alias("scan_seq"), F.format_string("/d%d/thumbs.db", "id").alias("path"), F.lit(5).cast("bigint").alias("size"))
    assert pairs.name_links(names, 80, same_dir=False).count() == n - 1
    songs = spark.range(n).select(F.col("id").alias("scan_seq"), F.lit("x").alias("artist"), F.lit("track").alias("title"), F.lit(9).alias("duration"))
    assert pairs.music_links(songs, 80).count() == n - 1
    videos = spark.range(n).select(F.col("id").alias("scan_seq"), F.array(F.lit(1), F.lit(2)).cast("array<bigint>").alias("sig"))
    assert pairs.video_links(videos, 10).count() == n - 1


@pytest.mark.parametrize("threshold", [5, 10, 60, 80, 95])
def test_songs_equal_nested_loop(spark, threshold):
    from tests.test_functions import score_spec, words_spec

    rng = np.random.default_rng(threshold)
    names = ["red rod", "rod red", "red rods", "old bolt", "old", "", "red rod old bolt", "bolt"]
    rows = [(int(k), "", str(rng.choice(names)), int(rng.choice([0, 0, 1, 2, 3, 9, 10, 11, 90, 100, 119]))) for k in rng.permutation(70)]
    fits = lambda a, b: 0 in (a, b) or min(a, b) >= max(a, b) * 85 // 100
    time = lambda a, b: 0.0 if 0 in (a, b) else 1.0 if min(a, b) >= max(a, b) * 9 // 10 else 0.5 if min(a, b) >= max(a, b) * 8 // 10 else 0.0
    want = {}
    rows.sort()
    for k, _, m, t in rows:
        for l, _, n, u in rows[k + 1 :]:
            score = 0.9 * score_spec(words_spec(m), words_spec(n), True) + 0.1 * time(t, u)
            if fits(t, u) and score >= threshold / 100:
                want[k, l] = score
    tags = spark.createDataFrame(rows, "scan_seq bigint, artist string, title string, duration bigint")
    got = pairs.music_pairs(tags, threshold).collect()
    assert len(got) == len(want) and {(r["src"], r["dst"]): r["score"] for r in got} == pytest.approx(want)
    assert {r["node"]: r["component"] for r in connected_components(pairs.music_links(tags, threshold)).collect()} == union_find(want)


def test_videos_equal_nested_loop(spark):
    rng = np.random.default_rng(8)
    pool = [0, *rng.integers(0, 2**62, 12).tolist()]
    pool += [p ^ 5 for p in pool]
    sigs = [[0] * int(rng.integers(0, 4)) + [pool[i] for i in rng.integers(0, len(pool), rng.integers(1, 7))] for _ in range(40)]
    sigs += [sigs[0], sigs[3], [], [0], [0, 0, 0]]
    near = lambda p, other: any((p ^ q).bit_count() <= 3 for q in other)
    share = lambda a, b: sum(near(p, b) for p in a) / len(a)
    want = {}
    for i, a in enumerate(sigs):
        for j in range(i + 1, len(sigs)):
            b = sigs[j]
            if a and b and (score := (share(a, b) + share(b, a)) / 2) >= 0.6:
                want[i, j] = score
    df = spark.createDataFrame(list(enumerate(sigs)), "scan_seq bigint, sig array<bigint>")
    got = pairs.video_pairs(df, 3).collect()
    assert len(got) == len(want) and {(r["src"], r["dst"]): r["score"] for r in got} == pytest.approx(want)
    assert {r["node"]: r["component"] for r in connected_components(pairs.video_links(df, 3)).collect()} == union_find(want)


def test_hub_join_is_split(spark):
    from tallyfold.operators.components import lowest_joined
    from tallyfold.plans.storage import write_table

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = write_table(spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("a"), (F.col("id") + 1).alias("b")), "hub")
        got = lowest_joined(edges, write_table(edges.groupBy("a").agg(F.min("b").alias("m")), "low"))
        assert len(got.collect()) == 40_000
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stored_leaves_one_table(spark):
    import os

    from tallyfold.plans.storage import shared_dir, stored, write_table

    shared = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    got = stored(spark, "kept", lambda: write_table(write_table(spark.range(9), "one"), "two"))
    assert got.count() == 9 and [n.split("-")[0] for n in set(os.listdir(shared)) - before] == ["kept"]


def test_large_groups_have_pages(spark):
    got = sorted((r["group_id"], r["page"], len(r["files"])) for r in groups.nested(members(spark), page=2).collect())
    assert got == [(0, 0, 2), (0, 1, 1), (3, 0, 2)]


def members(spark):
    f = files(spark, [("/a/x.txt", 10, 30), ("/a/deep/er/x1.txt", 10, 10), ("/b/long_name.txt", 10, 20), ("/c/y", 7, 5), ("/c/z", 7, 5), ("/c/none", 1, 1)])
    return exact.exact_members(f.withColumn("full_hash", F.col("size").cast("string")))


def test_keep_strategies(spark):
    m = members(spark)
    keeper = {s: {r["group_id"]: r["keeper"] for r in groups.group_summary(m, s).collect()} for s in ("newest", "oldest", "largest", "first")}
    assert keeper["newest"] == {0: "/a/x.txt", 3: "/c/y"} and keeper["oldest"][0] == "/a/deep/er/x1.txt" and keeper["first"][0] == "/a/x.txt"
    for s in keeper:
        assert {r["group_id"]: r["path"] for r in groups.ranked(m, s).where("pos = 0").collect()} == keeper[s]
    for r in groups.nested(m).collect():
        assert r["reclaimable"] == sum(f["size"] for f in r["files"]) - r["file_size"]


def test_summary_in_one_pass(spark):
    f = files(spark, [("/a", 10, 3), ("/b", 10, 1), ("/c", 10, 2), ("/d", 7, 5), ("/e", 7, 5), ("/f", 7, 4), ("/g", 1, 1)])
    f = f.withColumn("full_hash", F.when(F.col("path") == "/f", None).otherwise(F.col("size").cast("string")))
    for strategy in ("newest", "oldest", "largest", "first"):
        got = sorted(map(tuple, exact.exact_summary(f, strategy).collect()))
        want = sorted(map(tuple, groups.group_summary(exact.exact_members(f), strategy).select("group_id", "kind", "n_files", "file_size", "reclaimable", "keeper").collect()))
        assert got == want and [g[2] for g in got] == [3, 2]


def test_selection(spark):
    rows = groups.ranked(members(spark)).cache()
    checked = lambda df: {r["path"] for r in df.where("checked").collect()}
    assert checked(selection.default_selection(rows)) == {"/b/long_name.txt", "/a/x.txt", "/c/z"}
    assert checked(selection.keep_by(rows, "path_under_dir", "/A")) == {"/b/long_name.txt"}
    assert checked(selection.keep_by(rows, "depth_deep")) == {"/a/x.txt", "/b/long_name.txt", "/c/z"}
    assert checked(selection.select_by(rows, "name_contains", "NG_")) == {"/b/long_name.txt"}
    base = selection.default_selection(rows)
    assert checked(selection.invert(base)) == {"/a/deep/er/x1.txt", "/c/y"}
    assert checked(selection.toggle_file(base, 3, "/c/z")) == {"/b/long_name.txt", "/a/x.txt"}
    assert checked(selection.toggle_group(base, 3)) == {"/b/long_name.txt", "/a/x.txt", "/c/y", "/c/z"}
    assert checked(selection.select_none(base, F.col("group_id") == 0)) == {"/c/z"}
    assert selection.checked_count(selection.select_all(base)).first()[0] == 5
    with pytest.raises(ValueError):
        selection.keep_by(rows, "path_under_dir")
    done = spark.createDataFrame([("/c/z", True), ("/a/x.txt", True)], "path string, ok boolean")
    left = selection.after_actions(base, done, "delete")
    assert checked(left) == {"/b/long_name.txt"} and left.count() == 2
    assert selection.after_actions(base, done, "copy").count() == 5


def test_gates(spark):
    items = selection.checked_items(selection.select_all(groups.ranked(members(spark))))
    assert actions.gate(items, "hardlink").where("is_ref").count() == 0
    for kind in ("delete", "trash"):
        with pytest.raises(actions.ConfirmationNeeded):
            actions.gate(items, kind)
    assert actions.gate(items, "trash", confirm=True).count() == 5
    similar = items.withColumn("kind", F.lit("fuzzy_name"))
    with pytest.raises(actions.ConfirmationNeeded):
        actions.gate(similar, "move")


def test_tools(spark):
    f = files(spark, [("/r/big", 10_000, 0), ("/r/small", 100, 0), ("/r/mid", 1_000, 0), ("/r/Temp/~$a.tmp", 1, 0), ("/r/b.tmp", 1, 0), ("/tmp/c.txt", 1, 0), ("/r/Temp/d.txt", 0, 0)])
    assert [r["path"] for r in tools.big_files(f, 2).collect()] == ["/r/big", "/r/mid"]
    why = {r["path"]: r["detail"] for r in tools.temp_files(f).collect()}
    assert set(why) == {"/r/Temp/~$a.tmp", "/r/b.tmp", "/r/Temp/d.txt"} and why["/r/Temp/~$a.tmp"] == tools.LOCK_FILE and why["/r/b.tmp"].endswith("tmp")


def test_empty_folders(spark):
    rows = [("/r", "dir"), ("/r/a", "dir"), ("/r/a/e1", "dir"), ("/r/a/e2", "dir"), ("/r/a/e2/Thumbs.db", "file"), ("/r/b", "dir"), ("/r/b/f", "file"), ("/r/c", "dir"), ("/r/c/l", "link")]
    tree = spark.createDataFrame([(p, 0, 0, k, "/r") for p, k in rows], "path string, modified bigint, created bigint, entry_kind string, root string")
    assert [r["path"] for r in tools.empty_folders(tree).collect()] == ["/r/a"]
    assert tools.empty_folders(tree, recursive=False).count() == 0


def test_cache_merge(spark):
    row = lambda p, s, m, a, b: (p, s, m, a, b, 1)
    old = spark.createDataFrame([row("same", 1, 1, "p", "f"), row("changed", 1, 1, "p", "f"), row("old", 1, 1, "p", "f")], cache.SCAN)
    new = spark.createDataFrame([row("same", 1, 1, None, None), row("changed", 2, 1, "q", None), row("new", 1, 1, "n", None)], cache.SCAN)
    got = {r["path"]: (r["partial_hash"], r["full_hash"]) for r in cache.merge(old, new).collect()}
    assert got == {"same": ("p", "f"), "changed": ("q", None), "old": ("p", "f"), "new": ("n", None)}


def test_filters(spark):
    f = files(spark, [("/a/x.TXT", 5, 0), ("/a/none", 5, 0), ("/skip/y.txt", 50, 0)])
    pick = lambda **o: [r["path"] for r in filter_files(f, ScanOptions(**o)).orderBy("path").collect()]
    assert pick(only_extensions=("txt",)) == ["/a/x.TXT", "/skip/y.txt"]
    assert pick(exclude_extensions=("txt",)) == ["/a/none"]
    assert pick(exclude_paths=("skip",), min_size=5, max_size=5) == ["/a/none", "/a/x.TXT"]
    with pytest.raises(ValueError):
        ScanOptions(keep_strategy="best")


@pytest.mark.parametrize("rows", [1, 2, 700])
def test_tiles_equal_nested_loop(spark, rows):
    rng = np.random.default_rng(rows)
    h = rng.integers(0, 2**62, max(rows // 2, 1)).tolist()
    h = sorted({*h, *(x ^ int(sum(1 << int(i) for i in rng.choice(63, k, replace=False))) for x, k in zip(h, rng.integers(1, 25, rows - len(h))))})
    df = spark.createDataFrame([(x,) for x in h], "phash bigint")
    for radius in (0, 18, 64):
        want = {(p, q): (p ^ q).bit_count() for i, p in enumerate(h) for q in h[i + 1 :] if (p ^ q).bit_count() <= radius}
        got = [tuple(r) for r in tiles.tiled_pairs(df, radius, len(h)).collect()]
        assert len(got) == len(want) and {(p, q): d for p, q, d in got} == want


def test_bands_equal_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**62, 40).tolist()
    h += [x ^ int(sum(1 << int(i) for i in rng.choice(62, k, replace=False))) for x in h for k in (3, 10, 18, 19)]
    df = spark.createDataFrame(list(enumerate(h)), "scan_seq bigint, phash bigint")
    for radius in (2, 18):
        assert pairs._bands(radius, len(h)) is None
        got = sorted(pairs.hash_pairs(df, radius).collect())
        with monkeypatch.context() as m:
            m.setattr(pairs, "COMPARED", 1e-9)
            assert sorted(pairs.hash_pairs(df, radius).collect()) == got


def test_wide_radius_over_many_hashes_is_not_joined_by_bands():
    """Bands of 100,000 hashes within 18 bits list 1,732 neighbours each and join up to 28 % of all pairs, if bits are random."""
    assert pairs._bands(18, 100_000) is None
    assert pairs._bands(2, 1_000_000) is not None


def test_videos_are_scored_behind_several_hits(spark, monkeypatch):
    """One frame in common, as in every title sequence, makes no candidate; repeated frames count each."""
    share = lambda a, b: sum(any((p ^ q).bit_count() <= 10 for q in b) for p in a) / len(a)
    rng = np.random.default_rng(8)
    title, other = (int(x) for x in rng.integers(0, 2**62, 2))
    sigs = [[title, *(int(x) for x in rng.integers(0, 2**62, 9))] for _ in range(12)]
    sigs += [sigs[0][:6] + sigs[1][6:], sigs[2][:5] + sigs[3][5:], [title] * 7 + [other] * 3, [title, other], [other] * 70 + [title] * 3, [title] * 80]
    df = spark.createDataFrame(list(enumerate(sigs)), "scan_seq bigint, sig array<bigint>")
    seen, write = {}, pairs.write_table
    monkeypatch.setattr(pairs, "write_table", lambda t, name: seen.setdefault(name, write(t, name)))
    got = {(r["src"], r["dst"]): r["score"] for r in pairs.video_pairs(df, 10).collect()}
    want = {(i, j): s for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if (s := (share(sigs[i], sigs[j]) + share(sigs[j], sigs[i])) / 2) >= 0.6}
    assert got == pytest.approx(want) and want
    assert seen["video_candidates"].count() < 66


def test_groups_of_tiles_equal_components_of_pairs(spark, tmp_path, monkeypatch):
    """No band join behind images and videos at the radius of the queries; groups are those of all pairs."""
    from tallyfold import catalog

    rng = np.random.default_rng(11)
    v = rng.normal(size=(120, 64))
    v[60:] = v[:60] + rng.normal(size=(60, 64)) * rng.choice([0.1, 0.4, 0.8], (60, 1))
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    calls, tiled = [], pairs.tiled_pairs
    monkeypatch.setattr(pairs, "tiled_pairs", lambda *a: calls.append(1) or tiled(*a))
    for pair, group in (("hamming_pairs", "image_groups"), ("video_pairs", "video_groups")):
        edges = [(r["src"], r["dst"]) for r in catalog.QUERIES[pair](spark, str(tmp_path)).collect()]
        got = {r["scan_seq"]: r["group_id"] for r in catalog.QUERIES[group](spark, str(tmp_path)).collect()}
        assert edges and got == union_find(edges)
    assert len(calls) == 4


def test_copies_are_spelt_out_behind_the_join(spark, monkeypatch):
    """Many songs of few lists: no join has a row a pair, and arrays of members stay short."""
    from tallyfold.operators import word_join

    rng = np.random.default_rng(12)
    rows = [(i, ["Rod", "Bolt"][k], ["red rod", "rod red", "old bolt"][n], int(d)) for i, (k, n, d) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(0, 3, 300), rng.choice([0, 9, 10, 20], 300)))]
    songs = spark.createDataFrame(rows, "scan_seq bigint, artist string, title string, duration bigint")
    got = {}
    for chunk in (1024, 4):
        seen, write = {}, word_join.write_table
        with monkeypatch.context() as m:
            m.setattr(word_join, "CHUNK", chunk)
            m.setattr(word_join, "write_table", lambda t, name: seen.setdefault(name, write(t, name)))
            got[chunk] = sorted((r["src"], r["dst"], round(r["score"], 9)) for r in pairs.music_pairs(songs, 80).collect())
        longest = seen["node_members"].agg(F.max(F.size("seqs"))).first()[0]
        assert longest <= 5 * chunk and seen["node_members"].agg(F.sum(F.size("seqs"))).first()[0] == 300
    assert seen["node_members"].count() > 24 and got[4] == got[1024]
    from tests.test_functions import score_spec, words_spec

    want = set()
    for i, k, n, d in rows:
        for j, l, m_, e in rows[i + 1 :]:
            time = 0.0 if 0 in (d, e) else 1.0 if min(d, e) >= max(d, e) * 9 // 10 else 0.5 if min(d, e) >= max(d, e) * 8 // 10 else 0.0
            score = 0.9 * score_spec(words_spec(f"{k} {n}"), words_spec(f"{l} {m_}"), True) + 0.1 * time
            if (0 in (d, e) or min(d, e) >= max(d, e) * 85 // 100) and score >= 0.8:
                want.add((i, j, round(score, 9)))
    assert set(got[4]) == want and len(got[4]) == len(want)


@pytest.mark.parametrize("rare", [6, 30])
def test_names_by_forms_equal_nested_loop(spark, monkeypatch, rare):
    """Names with rare words near each other and near common ones, copies and sizes of every kind: forms change no pair, score or group."""
    from tallyfold.operators import member_tiles, word_join
    from tests.test_functions import score_spec, words_spec

    rng = np.random.default_rng(rare)
    word = lambda: str(rng.choice(["http", "https", "en", "net", "nets", str(rng.integers(100, 140)), str(rng.integers(10**5, 10**6)), "2", "x"], p=[0.2, 0.2, 0.15, 0.1, 0.05, 0.15, 0.05, 0.05, 0.05]))
    rows = [("/".join(word() for _ in range(rng.integers(1, 7))), int(rng.choice([0, 1, 3, 4, 5, 16, 17])), 0) for _ in range(70)]
    rows += [rows[0], rows[0], (rows[1][0], 4, 0), ("http/en/net/130/131", 4, 0), ("http/en/net/131/141", 4, 0), ("https/en/net/777/999999", None, 0)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    want = {}
    for i, (p, s, _) in enumerate(rows):
        for j, (q, t, _) in enumerate(rows[i + 1 :], i + 1):
            if None not in (s, t) and s <= 4 * t and t <= 4 * s and (score := score_spec(words_spec(p), words_spec(q), True)) >= 0.6:
                want[i, j] = score
    for wide, chunk in ((1000, 1024), (0, 3)):
        with monkeypatch.context() as m:
            m.setattr(word_join, "WIDE", wide)
            m.setattr(word_join, "RARE", rare)
            m.setattr(member_tiles, "CHUNK", chunk)
            m.setattr(member_tiles, "CELLS", 4 * chunk)
            m.setattr(member_tiles, "PAIRS", 5)
            got = pairs.name_pairs(files(spark, rows), 60, False, None, F.col("path")).collect()
            links = pairs.name_links(files(spark, rows), 60, False, None, F.col("path")).collect()
        assert len(got) == len(want) and {(r["src"], r["dst"]): r["score"] for r in got} == want
        assert {(r["src"], r["dst"]) for r in links} <= set(want) and union_find(map(tuple, links)) == union_find(want)


def test_names_of_a_form_are_not_scored_one_by_one(spark, monkeypatch):
    """Urls that differ in a number: pairs grow with the square, scores and edges don't."""
    from tallyfold.operators import word_join

    monkeypatch.setattr(word_join, "WIDE", 100, raising=False)
    monkeypatch.setattr(word_join, "RARE", 100, raising=False)
    f = files(spark, [(f"http://www.{'a' * (3 + 3 * (i % 3))}.example.net/en/{10**7 + i * 7919 * 131}", 9, 0) for i in range(300)])
    scored, write = [], word_join.write_table
    monkeypatch.setattr(word_join, "write_table", lambda t, name: (scored.append(write(t, name)) if name == "list_scores" else None) or (scored[-1] if name == "list_scores" else write(t, name)))
    assert pairs.name_pairs(f, 80, False, None, F.col("path")).count() == 3 * 100 * 99 // 2
    assert sum(t.count() for t in scored) < 1000
    assert pairs.name_links(f, 80, False, None, F.col("path")).count() < 3000


def test_groups_of_images_take_a_forest_of_each_tile(spark):
    """All of a cluster's hashes are near each other: edges grow with hashes, and components stay."""
    rng = np.random.default_rng(21)
    h = [int(c) ^ int(sum(1 << int(i) for i in rng.choice(62, 4, replace=False))) for c in rng.integers(0, 2**62, 3) for _ in range(120)] + rng.integers(0, 2**62, 40).tolist()
    df = spark.createDataFrame(list(enumerate(h)), "scan_seq bigint, phash bigint")
    edges = [tuple(r) for r in pairs.hash_links(df, 18).collect()]
    want = [(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if (h[i] ^ h[j]).bit_count() <= 18]
    assert union_find(edges) == union_find(want) and len(edges) < len(want) / 2


def test_copies_of_names_are_spelt_out_in_arrays(spark, tmp_path, monkeypatch):
    """Parts of few names: whole arrays meet, no row a member is joined, and no pair is lost or repeated."""
    from tallyfold import catalog
    from tallyfold.operators import member_tiles

    rng = np.random.default_rng(14)
    rows = [(int(k), ["red rod", "rod red", "old bolt"][n], "AB"[t]) for k, n, t in zip(rng.permutation(300), rng.integers(0, 3, 300), rng.integers(0, 2, 300))]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    calls, after = [], member_tiles.spelt_out
    monkeypatch.setattr(member_tiles, "spelt_out", lambda *a, **k: calls.append(1) or after(*a, **k))
    monkeypatch.setattr(member_tiles, "CHUNK", 16)
    want = sorted((a, b, 1.0) for a, n, t in rows for b, m, u in rows if a < b and t == u and sorted(n.split()) == sorted(m.split()))
    assert sorted(tuple(r) for r in catalog.QUERIES["fuzzy_exact_word_score"](spark, str(tmp_path)).collect()) == want and calls
    # Sizes decide within the same arrays.
    few = spark.createDataFrame([(i, 7, s) for i, s in enumerate([0, 1, 4, 5, 0, 16, 20])], "scan_seq bigint, id bigint, size bigint")
    got = after(member_tiles.member_nodes(few, "id"), spark.createDataFrame([(7, 7, 1.0)], "x bigint, y bigint, score double")).collect()
    assert sorted((r["src"], r["dst"]) for r in got) == [(0, 4), (1, 2), (2, 3), (2, 5), (3, 5), (3, 6), (5, 6)]


def test_words_matched_in_python(spark):
    """The greedy matches of a list in Python are those of the expression, and none below what is asked for."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("ab1"), rng.integers(1, 5)))
    rows = [([word() for _ in range(rng.integers(1, 7))], [word() for _ in range(rng.integers(1, 7))]) for _ in range(400)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for similar in (True, False):
        want = [r["n"] for r in df.select(text.common_words(F.col("a"), F.col("b"), similar).alias("n")).collect()]
        assert [text.matched_words(a, b, 0, similar) for a, b in rows] == want
        assert [text.matched_words(a, b, 2, similar) if len(a) > 1 else None for a, b in rows] == [n if n > 1 else None for n in want]
    assert text.matched_words(["", "a"], ["", "a"], 0) == 1


def test_rare_neighbours_meet_once(spark, monkeypatch):
    """Words one edit apart, each pair of rare ones once and no other candidate; a frequent word only from a rare one."""
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("ab1"), rng.integers(1, 6))) for _ in range(150)})
    cost = spark.createDataFrame([("", w, word_join.RARE + k % 2) for k, w in enumerate(words)], "bucket string, word string, cost bigint")
    got = sorted((r["word"], r["other"]) for r in word_join.rare_neighbours(cost).collect())
    near = lambda x, y: x == y or (min(len(x), len(y)) >= 2 and text._one_edit(x, y))
    rare = set(words[::2])
    want = sorted((x, y) for x in rare for y in words if near(x, y) and (y not in rare or x <= y))
    assert got == want and len(got) > 100
    apart = spark.createDataFrame([(x, y) for x in words[:60] for y in words if x != y], "x string, y string")
    assert all(r["near"] == text._one_edit(r["x"], r["y"]) for r in apart.select("x", "y", text.near_word(F.col("x"), F.col("y")).alias("near")).collect())


def test_sizes_of_copies(spark, monkeypatch):
    """Copies of several sizes, of one list and of lists one edit apart: the components of all pairs, by hardly more edges than rows."""
    rng = np.random.default_rng(6)
    sizes = [0, 1, 3, 11, 60, 241, 250, 5000]
    rows = [(int(i), f"/d/alpha beta gamma delta {w}", int(rng.choice(sizes))) for i, w in enumerate(rng.choice(["one", "ones", "onset", "zzz"], 300, p=[0.5, 0.3, 0.1, 0.1]))]
    f = spark.createDataFrame(rows, "scan_seq bigint, path string, size bigint")
    for wide in (word_join.WIDE, 1):
        monkeypatch.setattr(word_join, "WIDE", wide)
        want = union_find((r["src"], r["dst"]) for r in pairs.name_pairs(f, 95).collect())
        links = pairs.name_links(f, 95).collect()
        assert union_find((r["src"], r["dst"]) for r in links) == want and len(links) < 400


def test_near_frames_are_written_once(spark, monkeypatch):
    """Candidates read the near frames themselves; all videos of one hot frame and no other in common make no pair."""
    written, write = [], pairs.write_table
    monkeypatch.setattr(pairs, "write_table", lambda df, name: written.append(name) or write(df, name))
    rng = np.random.default_rng(8)
    own = rng.integers(0, 2**62, (40, 6))
    rows = [(i, [7, *map(int, f)]) for i, f in enumerate(own)] + [(40, [9, *map(int, own[3, :5]), 1 << 60])]
    got = pairs.video_pairs(spark.createDataFrame(rows, "scan_seq bigint, sig array<bigint>"), 3).collect()
    assert [(r["src"], r["dst"]) for r in got] == [(3, 40)]
    assert "met_frames" not in written and written.count("near_frames") == 1
