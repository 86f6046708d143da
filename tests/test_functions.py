from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.functions import bits, display, media, paths, text


def one(spark, **exprs):
    return spark.range(1).select(*(e.alias(n) for n, e in exprs.items())).first()


def words_spec(s: str) -> list[str]:
    out, run = [], ""
    for c in s.lower() + " ":
        if c.isascii() and c.isalnum():
            run += c
            continue
        if run:
            out.append(run)
            run = ""
        if 0x4E00 <= ord(c) <= 0x9FFF or 0x3400 <= ord(c) <= 0x4DBF or 0xF900 <= ord(c) <= 0xFAFF:
            out.append(c)
    return out


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def score_spec(a: list[str], b: list[str], similar: bool) -> float:
    left, n = list(b), 0
    for x in a:
        k = next((i for i, y in enumerate(left) if y == x), None)
        if k is None and similar and len(x) >= 2:
            k = next((i for i, y in enumerate(left) if y is not None and len(y) >= 2 and near(x, y)), None)
        if k is not None:
            left[k] = None
            n += 1
    return 2 * n / (len(a) + len(b)) if a and b else 0.0


def test_words(spark):
    texts = ["report_final_v2.txt", "文档A.txt", "Été déjà", "", "a--b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.words(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in got] == [words_spec(t) for t in texts]
    assert words_spec("report_final_v2.txt") == ["report", "final", "v2", "txt"]


@pytest.mark.parametrize(
    ("a", "b", "similar", "want"),
    [
        ("a b c d", "c d e", False, 4 / 7), ("report.txt", "report.txt", True, 1.0), ("报告.txt", "报告 副本.txt", True, 0.75), ("", "a", True, 0.0),
        ("bc ab", "bb bc", True, 1.0), ("bb bc", "bc ab", True, 0.5),
    ],
)
def test_word_score_cases(spark, a, b, similar, want):
    got = one(spark, s=text.word_score(text.words(F.lit(a)), text.words(F.lit(b)), similar))["s"]
    assert got == score_spec(words_spec(a), words_spec(b), similar)
    assert abs(got - want) < 1e-12


def test_word_score_random(spark):
    rng = np.random.default_rng(3)
    make = lambda: ["".join(rng.choice(list("abc"), rng.integers(1, 4))) for _ in range(rng.integers(0, 6))]
    cases = [(make(), make()) for _ in range(300)]
    got = spark.createDataFrame(cases, "a array<string>, b array<string>").select("a", "b", text.word_score(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(abs(r["s"] - score_spec(r["a"], r["b"], True)) < 1e-12 for r in got)


def test_ratio_and_duration(spark):
    size = lambda a, b: text.size_ratio_ok(F.lit(a), F.lit(b))
    got = one(spark, a=size(0, 0), b=size(0, 1), c=size(1, 4), d=size(1, 5), e=text.duration_ok(F.lit(269), F.lit(300)), f=text.duration_ok(F.lit(269), F.lit(240)), g=text.duration_ok(F.lit(269), F.lit(200)))
    assert list(got) == [True, False, True, False, True, True, False]


def test_paths(spark):
    rows = [("/a/.bashrc",), ("x.",), ("/d/a.tar.gz",), ("plain",), ("C:\\x\\Y.TXT",), ("/a/b/",)]
    p = F.col("p")
    got = spark.createDataFrame(rows, "p string").select(paths.extension(p).alias("e"), paths.parent_dir(p).alias("d"), paths.path_depth(p).alias("n"), paths.file_type(p).alias("t"), paths.file_name(p).alias("f")).collect()
    assert [r["e"] for r in got] == [None, "", "gz", None, "txt", None]
    assert [r["d"] for r in got] == ["/a", "", "/d", "", "C:\\x", "/a/b"]
    assert [r["n"] for r in got] == [2, 0, 2, 0, 2, 3]
    assert [r["t"] for r in got] == ["文件", "文件", "GZ", "文件", "TXT", "文件"]
    assert got[-1]["f"] == "/a/b/"


def test_under(spark):
    u = lambda x, d: paths.is_under(F.lit(x), d)
    got = one(spark, a=u("/A/b", "/a"), b=u("/a", "/A"), c=u("/ab", "/a"), d=u("c:\\x\\y", "C:\\X"), e=u("/a", None))
    assert list(got) == [True, True, False, True, False]


def test_display(spark):
    f = lambda n: display.format_bytes(F.lit(n))
    got = one(spark, a=f(1023), b=f(1024), c=f(1536), d=f(100 * 1024), e=f(5 * 1024**3), z=display.format_date(F.lit(0)))
    assert list(got) == ["1023 B", "1.0 KB", "1.5 KB", "100 KB", "5.0 GB", "-"]


def test_signature_text(spark):
    df = spark.createDataFrame([([0x0123456789ABCDEF, -2],)], "s array<bigint>").withColumn("t", bits.signature_text(F.col("s")))
    got = df.select("t", (bits.signature_of(F.col("t")) == F.col("s")).alias("same"), bits.signature_of(F.lit("12,xy")).alias("bad"), bits.hash_of_hex(F.lit("zz")).alias("hex")).first()
    assert got["t"] == "0123456789abcdef,fffffffffffffffe" and got["same"] and got["bad"] is None and got["hex"] is None


def test_frames(spark):
    s = lambda a, b: bits.frame_score(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)), 4)
    got = one(spark, a=s(range(10, 90, 10), range(11, 91, 10)), b=s([0] * 8, [2**62 - 1] * 8))
    assert got["a"] >= 0.9 and got["b"] < 0.3


def phash_spec(gray: np.ndarray) -> int:
    """Straight from the definition."""
    h, w = gray.shape
    m = np.zeros((32, 32))
    for y in range(32):
        for x in range(32):
            y0, x0 = y * h // 32, x * w // 32
            m[y, x] = gray[y0 : max((y + 1) * h // 32, y0 + 1), x0 : max((x + 1) * w // 32, x0 + 1)].astype(float).mean()
    dct = lambda v: np.array([(2**-0.5 if k == 0 else 1) * sum(v[i] * np.cos(np.pi * (2 * i + 1) * k / 64) for i in range(32)) for k in range(32)])
    rows = np.array([dct(r) for r in m])
    full = np.array([dct(c) for c in rows.T]).T
    ac = full[:8, :8].ravel()[1:]
    return sum(1 << i for i in range(63) if ac[i] > ac.mean())


def gradient(n: int, seed: int = 0) -> np.ndarray:
    return np.tile(np.minimum(np.arange(n) * 255 // n + seed, 255).astype(np.uint8), (n, 1))


def test_phash():
    rng = np.random.default_rng(1)
    for shape in ((50, 70), (20, 40), (64, 64)):
        gray = rng.integers(0, 256, shape).astype(np.uint8)
        assert media.phash(gray) == phash_spec(gray)
    assert (media.phash(gradient(100)) ^ media.phash(gradient(200))).bit_count() <= 6
    assert media.phash(np.zeros((0, 0), np.uint8)) is None


def test_durations():
    assert media.parse_duration("  Duration: 00:01:30.50, start") == 90.5
    assert media.parse_duration("none") is None
    assert media.frame_rate(240) == 0.1


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=30))
def test_parse_list(s):
    assert all(x and x == x.strip().lower() for x in text.parse_list(s))
