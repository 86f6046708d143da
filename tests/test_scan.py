"""Scans and actions over real folders."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import actions
from tallyfold.operators.cache import HashCache
from tallyfold.plans.options import ScanOptions
from tallyfold.plans.scan import scan
from tallyfold.sources.walker import check_roots, read_tree, scan_files
from tallyfold.streaming import progress

BODY = b"the quick brown fox jumps over the lazy dog!!"


def put(root, **made):
    for name, body in made.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)


def test_exact(spark, tmp_path):
    put(tmp_path, a_dot_txt=BODY, b_dot_txt=BODY, sub__d_dot_txt=BODY, sub__c_dot_txt=b"other", e_dot_bin=b"x" * 45)
    put(tmp_path, _dot_hidden=b"1")
    got = scan(spark, ScanOptions(paths=(str(tmp_path), str(tmp_path / "sub"))))
    group = got.groups.collect()
    assert len(group) == 1 and len(group[0]["files"]) == 3 and group[0]["reclaimable"] == 90
    assert got.summary.first()["scanned_files"] == 6
    got.write_json(str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") and spark.read.json(str(tmp_path / "out/groups")).count() == 1


def test_cache_hits(spark, tmp_path):
    data = tmp_path / "data"
    put(data, a_dot_bin=b"z" * 71_680, b_dot_bin=b"z" * 71_680)
    options = ScanOptions(paths=(str(data),), use_cache=True, cache_path=f"file://{tmp_path}/cache")
    assert scan(spark, options).summary.first()["cache_hits"] == 0
    again = scan(spark, options)
    assert again.summary.first()["cache_hits"] == 4 and again.groups.count() == 1
    (data / "a.bin").write_bytes(b"y" * 71_680)
    os.utime(data / "a.bin", (1, 1))
    assert scan(spark, options).groups.count() == 0
    store = HashCache(spark, options.cache_path)
    assert store.count() == store.clear() > 0 and store.count() == 0


def test_depth_and_roots(spark, tmp_path):
    put(tmp_path, a=b"1", x__b=b"1", x__y__c=b"1")
    names = lambda **o: sorted(os.path.basename(r["path"]) for r in scan_files(spark, ScanOptions(paths=(str(tmp_path),), **o)).collect())
    assert names() == ["a", "b", "c"] and names(max_depth=2) == ["a", "b"] and names(recursive=False) == ["a"]
    for bad in (tmp_path / "missing", tmp_path / "a"):
        with pytest.raises(ValueError):
            check_roots((str(bad),))
    os.symlink(tmp_path, tmp_path / "x" / "loop")
    assert read_tree(spark, (str(tmp_path),), follow=True).where("entry_kind = 'file'").count() >= 3


def test_similar_and_tools(spark, tmp_path):
    put(tmp_path, report_dot_txt=b"1", **{"report copy_dot_txt": b"22", "report final_dot_txt": b"333", "unrelated_dot_txt": b"4444"})
    put(tmp_path, **{"one_dot_png": b"aaaaa", "two_dot_png": b"bbbbbb", "flat_dot_png": b"ccccccc", "s1_dot_mp3": b"q" * 20, "s2_dot_mp3": b"q" * 21, "v1_dot_mp4": b"v" * 30, "v2_dot_mp4": b"v" * 31})
    put(tmp_path, temp_dot_tmp=b"t" * 9, big_dot_bin=b"x" * 20_000)
    (tmp_path / "empty_dir").mkdir()

    def decode(path):
        n = {"one": 100, "two": 200}.get(os.path.basename(path)[:3])
        return np.full((50, 50), 128, np.uint8) if n is None else np.tile((np.arange(n) * 255 // n).astype(np.uint8), (n, 1))

    def frames(path):
        rng = np.random.default_rng(1)
        return [rng.integers(0, 256, (64, 64)).astype(np.uint8) for _ in range(8)]

    options = ScanOptions(
        paths=(str(tmp_path),), fuzzy_filename=True, fuzzy_threshold=60, similar_images=True, music_dedup=True, similar_videos=True, tool_empty_folders=True, tool_big_files=True,
        tool_big_files_count=1, tool_temp_files=True,
    )
    got = scan(spark, options, decode, lambda p: ("周杰伦", "晴天", "", 269), frames)
    kinds = {}
    for r in got.members.collect():
        kinds.setdefault(r["kind"], set()).add(os.path.basename(r["path"]))
    assert kinds["fuzzy_name"] >= {"report.txt", "report copy.txt", "report final.txt"} and "unrelated.txt" not in kinds["fuzzy_name"]
    assert kinds["similar_image"] == {"one.png", "two.png"}
    assert kinds["music_tag"] == {"s1.mp3", "s2.mp3"} and kinds["similar_video"] == {"v1.mp4", "v2.mp4"}
    tools = {r["kind"]: os.path.basename(r["path"]) for r in got.tools.collect()}
    assert tools == {"empty_folder": "empty_dir", "big_file": "big.bin", "temp_file": "temp.tmp"}
    done = {os.path.basename(r["path"]): r["ok"] for r in actions.remove_empty(got.tools.where("kind = 'empty_folder'")).collect()}
    assert done == {"empty_dir": True} and not (tmp_path / "empty_dir").exists()


def test_missing_decoder_fails(spark, tmp_path):
    from tallyfold.sources import media

    def absent(path):
        import no_such_decoder  # noqa: F401

    def broken(path):
        raise OSError(path)

    put(tmp_path, a_dot_png=b"1", b_dot_mp3=b"2", c_dot_mp4=b"3")
    found = scan_files(spark, ScanOptions(paths=(str(tmp_path),)))
    for read in (lambda f: media.image_hashes(found, f), lambda f: media.music_tags(found, f), lambda f: media.video_signatures(found, frames=f)):
        with pytest.raises(Exception, match="no_such_decoder"):
            read(absent).collect()
        assert read(broken).count() == 0


def items(spark, *rows):
    out = []
    for path, reference in rows:
        s = os.stat(path)
        out.append((str(path), s.st_size, int(s.st_mtime), str(reference) if reference else None))
    return spark.createDataFrame(out, "path string, size bigint, modified bigint, reference string")


def test_actions(spark, tmp_path):
    put(tmp_path, a1=b"one", a2=b"one", b1=b"two", b2=b"two", c=b"three", d=b"four")
    got = actions.execute(items(spark, (tmp_path / "a2", tmp_path / "a1"), (tmp_path / "b2", tmp_path / "b1")), "hardlink").collect()
    assert all(r["ok"] for r in got)
    assert os.path.samefile(tmp_path / "a1", tmp_path / "a2") and os.path.samefile(tmp_path / "b1", tmp_path / "b2")
    old = items(spark, (tmp_path / "c", None))
    (tmp_path / "c").write_bytes(b"changed")
    assert not actions.execute(old, "delete").first()["ok"] and (tmp_path / "c").exists()
    assert actions.execute(items(spark, (tmp_path / "c", None)), "copy", str(tmp_path / "to")).first()["ok"]
    assert not actions.execute(items(spark, (tmp_path / "c", None)), "move", str(tmp_path / "to")).first()["ok"]
    assert actions.execute(items(spark, (tmp_path / "d", None)), "trash", str(tmp_path / "bin")).first()["ok"] and (tmp_path / "bin/d").exists()
    assert actions.execute(items(spark, (tmp_path / "c", None)), "delete").first()["ok"] and not (tmp_path / "c").exists()
    with pytest.raises(ValueError):
        actions.execute(items(spark, (tmp_path / "a1", None)), "move")


def test_equal_names_in_the_trash(spark, tmp_path):
    put(tmp_path, x__a_dot_jpg=b"one", y__a_dot_jpg=b"two", z__a_dot_jpg=b"three")
    rows = items(spark, *((tmp_path / d / "a.jpg", None) for d in "xyz"))
    assert all(r["ok"] for r in actions.execute(rows, "trash", str(tmp_path / "bin")).collect())
    assert sorted(os.listdir(tmp_path / "bin")) == ["a (1).jpg", "a (2).jpg", "a.jpg"]
    assert {(tmp_path / "bin" / n).read_bytes() for n in os.listdir(tmp_path / "bin")} == {b"one", b"two", b"three"}


@pytest.mark.parametrize("kind", actions.ACTIONS)
def test_a_task_that_runs_again_reports_ok(spark, tmp_path, monkeypatch, kind):
    put(tmp_path, a_dot_txt=b"same", b_dot_txt=b"same", keep_dot_txt=b"same")
    rows = items(spark, (tmp_path / "a.txt", tmp_path / "keep.txt"), (tmp_path / "b.txt", tmp_path / "keep.txt")).toPandas()
    args = (kind, str(tmp_path / "to"), str(tmp_path / "journal"))
    finish = actions.Journal.finish

    def killed(self, path):
        if path.endswith("b.txt"):
            raise KeyboardInterrupt
        finish(self, path)

    monkeypatch.setattr(actions.Journal, "finish", killed)
    with pytest.raises(KeyboardInterrupt):
        actions.perform(rows, *args)
    monkeypatch.undo()
    for _ in range(2):
        assert actions.perform(rows, *args)["ok"].all()
    left = {n for n in os.listdir(tmp_path) if n.endswith(".txt")}
    assert left == ({"a.txt", "b.txt", "keep.txt"} if kind in ("hardlink", "copy") else {"keep.txt"})
    if kind in ("move", "copy", "trash"):
        assert sorted(os.listdir(tmp_path / "to")) == ["a.txt", "b.txt"]


def test_a_result_computed_twice_acts_once(spark, tmp_path):
    put(tmp_path, a=b"1")
    got = actions.execute(items(spark, (tmp_path / "a", None)), "delete")
    assert got.first()["ok"] and got.first()["ok"] and not (tmp_path / "a").exists()
    assert not actions.execute(items(spark, (tmp_path, None)), "delete").first()["ok"]


def test_media_memo(spark, tmp_path):
    data, log = tmp_path / "data", tmp_path / "log"
    put(data, a_dot_png=b"aaaaa", b_dot_png=b"bbbbbb", v1_dot_mp4=b"v" * 30, v2_dot_mp4=b"v" * 31)
    log.mkdir()

    def note(path):
        (log / f"{os.path.basename(path)}.{os.getpid()}.{os.urandom(4).hex()}").write_bytes(b"")

    def decode(path):
        note(path)
        return np.tile((np.arange(100) * 2).astype(np.uint8), (100, 1))

    def frames(path):
        note(path)
        return [np.random.default_rng(1).integers(0, 256, (64, 64)).astype(np.uint8) for _ in range(8)]

    options = ScanOptions(paths=(str(data),), use_cache=True, cache_path=f"file://{tmp_path}/cache", similar_images=True, similar_videos=True)
    kinds = lambda: sorted(r["kind"] for r in scan(spark, options, decode, None, frames).members.select("kind", "path").collect())
    assert kinds() == ["similar_image"] * 2 + ["similar_video"] * 2
    seen = len(os.listdir(log))
    assert seen == 4 and kinds() == ["similar_image"] * 2 + ["similar_video"] * 2 and len(os.listdir(log)) == seen
    (data / "a.png").write_bytes(b"changed!")
    kinds()
    assert len(os.listdir(log)) == seen + 1


def test_creation_time(spark, tmp_path):
    put(tmp_path, a=b"1")
    (got,) = scan_files(spark, ScanOptions(paths=(str(tmp_path),))).collect()
    if os.uname().sysname == "Linux":
        told = os.popen(f"stat -c %W {tmp_path}/a").read().strip()
        assert got["created"] == max(0, int(told if told != "-" else 0))


def test_a_lopsided_tree_is_dealt_out(tmp_path, monkeypatch):
    from tallyfold.sources import walker

    put(tmp_path, **{f"only__d{k}__e{k % 3}__f{k}": b"1" for k in range(9)})
    want = None
    for parts in (1, 4, 9, 512):
        monkeypatch.setattr(walker, "PARTS", parts)
        reader = walker.TreeReader({"roots": str(tmp_path)})
        got = reader.partitions()
        rows = sorted(r for p in got for r in reader.read(p))
        assert len({r[0] for r in rows}) == len(rows) == 1 + 1 + 9 + 9 + 9
        want = want or rows
        assert rows == want and len(got) >= min(parts, 11)


def test_triangle_filter():
    from tallyfold.functions import media

    w = media.triangle_weights(64, 32)
    assert np.allclose(w.sum(axis=1), 1) and np.allclose(w[5, 9:14], [0.125 / 1, 0.375, 0.375, 0.125, 0])
    color = np.random.default_rng(0).integers(0, 256, (50, 70, 3))
    plain = np.zeros((32, 32, 3))
    for y in range(32):
        for x in range(32):
            total = 0.0
            for r in range(50):
                for c in range(70):
                    a = max(0.0, 1 - abs(r + 0.5 - (y + 0.5) * 50 / 32) / (50 / 32)) * max(0.0, 1 - abs(c + 0.5 - (x + 0.5) * 70 / 32) / (70 / 32))
                    if a:
                        plain[y, x] += a * color[r, c]
                        total += a
            plain[y, x] /= total
    assert media.image_phash(color) == media.phash(media.luma(np.floor(plain + 0.5).astype(int)))
    assert media.image_phash(np.empty((0, 3))) is None


def test_progress(spark):
    with progress.tagged(spark, "scan-1") as tag:
        assert tag in spark.getTags()
    assert "scan-1" not in spark.getTags() and progress.cancel(spark, "scan-1") == []
    assert progress.percent("hash", 1, 2) == 45 and progress.percent("done", 0, 0) == 100
    assert spark.range(3).select(F.col("id")).count() == 3
