"""Media features by path (S9-S12): decoders are passed in, as none is part of the base installation.

A file on which a decoder fails drops out of that comparison; a package that a decoder misses is an error.
"""

from __future__ import annotations

import importlib
import os
import shutil
import subprocess
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyfold.functions.media import frame_rate, image_phash, parse_duration, phash
from tallyfold.operators.filters import has_extension
from tallyfold.plans.options import IMAGE_EXTENSIONS, MUSIC_EXTENSIONS, VIDEO_EXTENSIONS
from pyspark.sql import functions as F

MAX_FRAMES, FRAME = 24, 64


def pillow_pixels(path: str) -> np.ndarray:
    """S9 where Pillow is installed: red, green and blue."""
    from PIL import Image

    with Image.open(path) as image:
        return np.asarray(image.convert("RGB"))


def mutagen_tags(path: str) -> tuple[str, str, str, int] | None:
    """S10 where Mutagen is installed: artist, title, album, seconds."""
    import mutagen

    found = mutagen.File(path, easy=True)
    if found is None or not found.tags:
        return None
    first = lambda k: (found.tags.get(k) or [""])[0]
    return first("artist"), first("title"), first("album"), int(getattr(found.info, "length", 0) or 0)


def find_ffmpeg(path: str = "") -> str | None:
    """The given file, else one beside the program, else what the search path has."""
    if path and os.path.isfile(path):
        return path
    return shutil.which("ffmpeg", path=os.path.dirname(sys.executable)) or shutil.which("ffmpeg")


def ffmpeg_frames(path: str, ffmpeg: str) -> np.ndarray:
    """Up to MAX_FRAMES gray frames over the whole video."""
    seen = subprocess.run([ffmpeg, "-i", path], capture_output=True, text=True, errors="replace", timeout=60)
    rate = frame_rate(parse_duration(seen.stderr) or 0.0, MAX_FRAMES)
    args = [ffmpeg, "-v", "error", "-i", path, "-vf", f"fps={rate:.6f},scale={FRAME}:{FRAME}", "-frames:v", str(MAX_FRAMES), "-pix_fmt", "gray", "-f", "rawvideo", "-"]
    raw = subprocess.run(args, capture_output=True, timeout=600).stdout
    n = len(raw) // (FRAME * FRAME)
    return np.frombuffer(raw[: n * FRAME * FRAME], np.uint8).reshape(n, FRAME, FRAME)


def _features(files: DataFrame, extensions: tuple[str, ...], fields: str, read: Callable[[str], tuple], needs: str = "") -> DataFrame:
    """``read`` of each file; ``needs`` names the module that it imports."""

    def done(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if needs and len(batch):
                importlib.import_module(needs)
            out = []
            for seq, path in zip(batch["scan_seq"], batch["path"]):
                try:
                    got = read(path)
                except ImportError:
                    raise
                except Exception:  # noqa: BLE001  a broken file is not an error of the scan
                    got = None
                if got is not None:
                    out.append((seq, *got))
            yield pd.DataFrame(out, columns=["scan_seq", *(f.split()[0] for f in fields.split(", "))])

    chosen = files.where(has_extension(F.col("path"), extensions)).select("scan_seq", "path").repartition("path")
    return chosen.mapInPandas(done, f"scan_seq bigint, {fields}")


def image_hashes(files: DataFrame, decode: Callable[[str], np.ndarray] = pillow_pixels) -> DataFrame:
    """(scan_seq, phash) of the images that can be read."""

    def read(path: str) -> tuple | None:
        got = image_phash(decode(path))
        return None if got is None else (got,)

    return _features(files, IMAGE_EXTENSIONS, "phash bigint", read, "PIL.Image" if decode is pillow_pixels else "")


def music_tags(files: DataFrame, read_tags: Callable[[str], tuple | None] = mutagen_tags) -> DataFrame:
    """(scan_seq, artist, title, album, duration) of the music files with tags."""
    return _features(files, MUSIC_EXTENSIONS, "artist string, title string, album string, duration bigint", read_tags, "mutagen" if read_tags is mutagen_tags else "")


def video_signatures(files: DataFrame, ffmpeg: str = "", frames: Callable[[str], np.ndarray] | None = None) -> DataFrame:
    """(scan_seq, sig) of the videos that can be read; empty without a decoder."""
    if frames is None:
        tool = find_ffmpeg(ffmpeg)
        if tool is None:
            return files.sparkSession.createDataFrame([], "scan_seq bigint, sig array<bigint>")
        frames = lambda path: ffmpeg_frames(path, tool)

    def read(path: str) -> tuple | None:
        sig = [phash(f) for f in frames(path)]
        return (sig,) if sig else None

    return _features(files, VIDEO_EXTENSIONS, "sig array<bigint>", read)
