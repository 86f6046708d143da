"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

Merging adjacent pairs by score never crosses the boundaries that are left at the end, so the tokens of
a text's prefix are tokens of the text as far as they go: every prefix has exactly one possible last
token. One automaton pass finds the pieces that end at each character; the one that fits is the one
whose pair with the last token before it is left alone when the two are merged together. The table of
last tokens is then read backwards for the ids. The work is linear in the text's length, with no
priority queue, whatever the length of an unbroken run.

No piece of such a model holds a space mark after another character, so a text falls apart before runs
of marks, and at line ends if no piece holds one, and each part is encoded by itself; parts that come
again are remembered, in a table of bounded size. Decoding turns ids back by the same model.

Null and empty texts have no ids and decode to the empty text. Very long texts are encoded whole.
Repeated rows give repeated results; an empty table gives an empty one. Other columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.columns import small_batches

MARK = "▁"
#: Parts remembered by a worker, each of at most PART_CHARS characters, and token pairs remembered.
PARTS, PART_CHARS, PAIRS = 400_000, 48, 300_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceModel:
    """Ids of a text and text of ids for one BPE model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, pieces = model.normalizer_spec, model.pieces
        kinds = {p.type for p in pieces}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a BPE model with byte fallback and without user-defined pieces is needed")
        if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("a model with the identity normalizer is needed")
        order = {s: k for k, s in enumerate(sorted({p.score for p in pieces if p.type == NORMAL}, reverse=True))}
        self.ids = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        self.rank = {p.piece: order[p.score] for p in pieces if p.type == NORMAL}
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        self.byte_of: dict[int, int] = {}
        for i, p in enumerate(pieces):
            if p.type == BYTE:
                self.byte_of[i] = int(p.piece[3:5], 16)
                self.byte_ids[self.byte_of[i]] = i
                self.raw.append(bytes([self.byte_of[i]]))
            else:
                shown = {NORMAL: p.piece.replace(MARK, " "), UNKNOWN: " ⁇ ", CONTROL: ""}[p.type]
                self.raw.append(shown.encode())
        self.marked = {i for p, i in self.ids.items() if p.startswith(MARK)}
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.lines = not any("\n" in p for p in self.ids)
        self.tokens = dict(enumerate(p.piece for p in pieces))
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        for char in {c for p in self.ids for c in p} - self.ids.keys():  # they merge, but stand for bytes when left alone
            self.tokens[i := len(self.tokens)] = char
            self.automaton.add_word(char, (i, 1))
        self.automaton.make_automaton()
        self.known = len(pieces)
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _merged(self, text: str) -> list[str]:
        """What merging by score leaves of a short text."""
        at, rank = list(text), self.rank
        while True:
            best, where = None, -1
            for k in range(len(at) - 1):
                r = rank.get(at[k] + at[k + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, k
            if best is None:
                return at
            at[where : where + 2] = [at[where] + at[where + 1]]

    def _fits(self, before: int, token: int) -> bool:
        """Whether the two tokens stay as they are side by side; before: -1 at the start of the text."""
        key = before << 24 | token
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            left = [self.tokens[before]] if before >= 0 else []
            got = self.pairs[key] = self._merged("".join(left) + self.tokens[token]) == [*left, self.tokens[token]]
        return got

    def part_ids(self, text: str) -> tuple[int, ...]:
        """The ids of a text in which spaces are marks already."""
        last, fits, pairs = [None] * (len(text) + 1), self._fits, self.pairs
        last[0] = -1
        for end, (token, length) in self.automaton.iter(text):
            if last[end + 1] is None:
                before = last[end + 1 - length]
                # A character that no piece has merges with nothing: what follows it is as at a start.
                before = -1 if before is None else before
                ok = pairs.get(before << 24 | token)
                if ok or ok is None and fits(before, token):
                    last[end + 1] = token
        out, at = [], len(text)
        while at:
            token = last[at]
            if token is not None and token < self.known:
                out.append(token)
                at -= len(self.tokens[token])
            else:
                at -= 1
                out.extend(self.byte_ids[b] for b in reversed(text[at].encode("utf-8", "replace")))
        return tuple(reversed(out))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.splits and "  " not in text and MARK not in text and text[0] != " ":
            cut = (MARK + text).replace(" ", " " + MARK)
            cut = (cut.replace("\n", " \n ") if self.lines else cut).split(" ")
        elif self.splits:
            cut = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+$", (MARK + text).replace(" ", MARK))
        else:
            cut = [(MARK + text).replace(" ", MARK)]
        if len(self.parts) >= PARTS // 2:  # two generations: what is met again moves on, the rest is forgotten
            self.older, self.parts = self.parts, {}
        parts = self.parts
        found = list(map(parts.get, cut))
        if None in found:
            for k, got in enumerate(found):
                if got is None:
                    part = cut[k]
                    found[k] = got = parts.get(part) or self.older.get(part) or self.part_ids(part)
                    if len(part) <= PART_CHARS:
                        parts[part] = got
        return list(chain.from_iterable(found))

    def decode(self, ids: Iterable[int] | None) -> str:
        ids = list(ids or ())
        raw = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_bytewise(ids)
        first = next((i for i in ids if self.raw[i]), None)
        return text[1:] if first in self.marked else text

    def _decode_bytewise(self, ids: list[int]) -> str:
        """A run of byte pieces that isn't UTF-8 gives one replacement mark for each stray byte."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                at += size
            run.clear()

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
            else:
                flush()
                out.append(self.raw[i].decode())
        flush()
        return "".join(out)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """The model of a worker, read once."""
    return PieceModel(path)


def _coded(batches: Iterator[pa.RecordBatch], path: str, kind: pa.DataType, step: int = 256) -> Iterator[pa.RecordBatch]:
    model = piece_model(path)
    for whole in batches:
        for lo in range(0, whole.num_rows, step):
            batch = whole.slice(lo, step)
            ids = [model.encode(t) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0).cast(kind), pa.array(ids, pa.list_(pa.int32())), pa.array(map(model.decode, ids), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "ids", "decoded"])
    model.older = {}  # what a worker holds between tasks is one generation


def encode_decode(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and decoded for each row. ``model_path`` is read on the executors."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(df.sparkSession)
    kind = df.schema[doc_id].dataType
    arrow = to_arrow_type(kind)
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {kind.simpleString()}, ids array<int>, decoded string"
    return rows.mapInArrow(lambda it: _coded(it, model_path, arrow), schema).withColumnRenamed("id", doc_id)


def digests(coded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids in decimal, joined by commas, and of the decoded text."""
    return coded.select(
        doc_id, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
