"""File actions (M1-M8): planned as a DataFrame, carried out apart, and only when asked to.

``plan_actions`` and the gates have no side effect. ``execute`` checks each file right before it acts:
it must still have the size and time it was planned with. One result row comes back for each item.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import shutil
import stat
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.plans.storage import shared_dir

ACTIONS = ("trash", "delete", "hardlink", "move", "copy")
RESULT = "path string, ok boolean, message string"


class ConfirmationNeeded(ValueError):
    """The action needs ``confirm=True``."""


def gate(items: DataFrame, kind: str, confirm: bool = False) -> DataFrame:
    """A hardlink leaves keepers out; deleting, touching keepers and acting on groups that aren't exact needs confirmation."""
    if kind not in ACTIONS:
        raise ValueError(f"an action is one of {ACTIONS}")
    if kind == "hardlink":
        items = items.where(~F.col("is_ref"))
    if not confirm:
        if kind == "delete":
            raise ConfirmationNeeded("files would be deleted for good")
        risky = items.where(F.col("kind") != "exact") if kind != "trash" else items.where((F.col("kind") != "exact") | F.col("is_ref"))
        if not risky.isEmpty():
            raise ConfirmationNeeded("keepers or files that are only similar are among the items")
    return items


def sample(items: DataFrame, n: int = 5) -> DataFrame:
    """What a confirmation shows."""
    return items.orderBy("group_id", "pos").limit(n)


def plan_actions(items: DataFrame, current: DataFrame, kind: str) -> DataFrame:
    """Each item with the action and whether a fresh inventory still has it as it was."""
    now = current.select("path", F.col("size").alias("__s"), F.col("modified").alias("__m"))
    got = items.join(now, "path", "left")
    state = F.when(F.col("__s").isNull(), "missing").when(F.col("__s") != F.col("size"), "size changed").when(F.col("__m") != F.col("modified"), "time changed").otherwise("ready")
    return got.withColumns({"action": F.lit(kind), "state": state}).drop("__s", "__m")


def _unchanged(path: str, size: int, modified: int) -> None:
    if not os.path.isfile(path):
        raise FileNotFoundError("the file is gone")
    now = os.stat(path)
    if now.st_size != size or int(now.st_mtime) != modified:
        raise ValueError("the file has changed since the scan")


def _writable(path: str) -> None:
    os.chmod(path, os.stat(path).st_mode | stat.S_IWUSR)


def _claimed(path: str, folder: str, number: bool) -> str:
    """An empty file of the name in ``folder`` that nobody else has; with ``number`` a name that is taken gets a number."""
    os.makedirs(folder, exist_ok=True)
    stem, ext = os.path.splitext(os.path.basename(path))
    for k in itertools.count():
        target = os.path.join(folder, f"{stem} ({k}){ext}" if k else stem + ext)
        try:
            os.close(os.open(target, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return target
        except FileExistsError:
            if not number:
                raise FileExistsError(f"{target} exists") from None
    raise AssertionError


def _put(kind: str, path: str, target: str) -> None:
    """The file as ``target``, which is claimed; a half-made copy never stands there."""
    new = f"{target}.{uuid.uuid4().hex}"
    try:
        (shutil.copy2 if kind == "copy" else shutil.move)(path, new)
        os.replace(new, target)
    except OSError:
        for left in (new, target):
            if os.path.lexists(left) and not (left == new and not os.path.exists(path)):
                os.remove(left)
        raise


def _link(path: str, reference: str) -> None:
    if os.path.samefile(path, reference):
        return
    new = f"{path}.{uuid.uuid4().hex}"
    os.link(reference, new)
    try:
        os.replace(new, path)  # at once: the path is never without a file
    except OSError:
        os.remove(new)
        raise


class Journal:
    """What is meant and what is done, a file each for an item, in a folder that all executors share.

    A task that runs again, or twice at once, finds there what an earlier one did: it repeats the answer of what is
    done, and of what was only meant it looks whether the effect is there. Without a folder nothing is recorded.
    """

    def __init__(self, folder: str | None):
        self.folder = folder

    def _name(self, path: str, end: str) -> str:
        return os.path.join(self.folder or "", hashlib.sha256(os.fsencode(path)).hexdigest() + end)

    def _read(self, path: str, end: str) -> str | None:
        try:
            with open(self._name(path, end), encoding="utf-8", errors="surrogateescape") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def _write(self, path: str, end: str, text: str) -> None:
        new = f"{self._name(path, end)}.{uuid.uuid4().hex}"
        with open(new, "w", encoding="utf-8", errors="surrogateescape") as f:
            f.write(text)
        os.replace(new, self._name(path, end))

    def done(self, path: str) -> str | None:
        return self._read(path, ".done") if self.folder else None

    def meant(self, path: str) -> str | None:
        """The target of an earlier attempt, empty where the action has none; None for a first attempt."""
        return self._read(path, ".meant") if self.folder else None

    def mean(self, path: str, target: str) -> None:
        if self.folder:
            os.makedirs(self.folder, exist_ok=True)
            self._write(path, ".meant", target)

    def finish(self, path: str) -> None:
        if self.folder:
            self._write(path, ".done", "ok")


def _effect(kind: str, path: str, size: int, reference: str | None, target: str) -> bool:
    """Whether the action has happened."""
    if kind == "delete":
        return not os.path.lexists(path)
    if kind == "hardlink":
        return bool(reference) and os.path.isfile(path) and os.path.isfile(reference) and os.path.samefile(path, reference)
    there = os.path.isfile(target) and os.stat(target).st_size == size
    return there if kind == "copy" and size else there and not os.path.lexists(path)


def act(kind: str, path: str, size: int, modified: int, reference: str | None, folder: str | None, journal: Journal | None = None) -> None:
    """M1-M6 for one item; a name that the trash has already gets a number, a move or copy onto one is refused."""
    journal = journal or Journal(None)
    if journal.done(path) is not None:
        return
    before = journal.meant(path)
    if before is not None and _effect(kind, path, size, reference, before):
        journal.finish(path)
        return
    _unchanged(path, size, modified)
    if kind == "hardlink" and (not reference or not os.path.isfile(reference)):
        raise FileNotFoundError("the reference is gone")
    target = before or ""
    if kind in ("move", "trash", "copy") and not target:
        target = _claimed(path, folder or "", kind == "trash")
    journal.mean(path, target)
    if kind == "delete":
        _writable(path)
        os.remove(path)
    elif kind == "hardlink":
        _link(path, reference)
    else:
        _put(kind, path, target)
    journal.finish(path)


def perform(batch: pd.DataFrame, kind: str, folder: str | None, journal: str | None) -> pd.DataFrame:
    """(path, ok, message) of a batch of items."""
    out, book = [], Journal(journal)
    for path, size, modified, reference in batch.itertuples(index=False):
        try:
            act(kind, path, size, modified, reference, folder, book)
            out.append((path, True, "ok"))
        except (OSError, ValueError) as e:
            out.append((path, False, str(e)))
    return pd.DataFrame(out, columns=["path", "ok", "message"])


def execute(items: DataFrame, kind: str, folder: str | None = None, journal: str | None = None) -> DataFrame:
    """M7: (path, ok, message). ``folder`` is where trash, move and copy put files. Acts whenever it is computed.

    ``journal`` is a folder that all executors share, as they share the files; by default one in the shared folder of
    the session where that is a plain path. The journal of a call is its own, so a task that runs again reports what
    the first attempt did, and a result that is computed twice acts once.
    """
    if kind not in ACTIONS:
        raise ValueError(f"an action is one of {ACTIONS}")
    if kind in ("trash", "move", "copy") and not folder:
        raise ValueError("a folder is needed")
    if journal is None:
        shared = shared_dir(items.sparkSession)
        if not shared.startswith(("/", "file:/")):
            raise ValueError("name a journal folder that all executors share as a plain path")
        journal = "/" + shared.removeprefix("file:").lstrip("/")
    journal = f"{journal}/actions-{uuid.uuid4().hex}"

    def done(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield perform(batch, kind, folder, journal)

    return items.select("path", "size", "modified", F.col("reference") if "reference" in items.columns else F.lit(None).cast("string").alias("reference")).mapInPandas(done, RESULT)


def remove_empty(folders: DataFrame, recurse: bool = False) -> DataFrame:
    """M8: removes folders that are still empty; with ``recurse`` also those of empty folders and ignorable files alone."""
    from tallyfold.plans.options import IGNORABLE_NAMES

    def one(path: str) -> None:
        if recurse:
            for _, _, names in os.walk(path):
                if any(n.lower() not in IGNORABLE_NAMES for n in names):
                    raise ValueError("the folder is not empty")
            shutil.rmtree(path)
        else:
            os.rmdir(path)

    def done(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    if not os.path.isdir(path):
                        raise FileNotFoundError("the folder is gone")
                    one(path)
                    out.append((path, True, "ok"))
                except (OSError, ValueError) as e:
                    out.append((path, False, str(e)))
            yield pd.DataFrame(out, columns=["path", "ok", "message"])

    return folders.select("path").mapInPandas(done, RESULT)
