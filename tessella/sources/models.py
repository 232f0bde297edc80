"""Learned models: where they are, whether they are whole, how they come there, and sessions that run them.

Sets of models are folders on the driver; their bytes travel to the executors by broadcast. No model is part of this package.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable, Sequence
from pathlib import Path

#: What an extractor and a matcher need; a set may have either.
EXTRACTOR, MATCHER = ("extractor.onnx", "descriptor_head.bin"), ("matcher.onnx",)
ABANDONED_AFTER = 3600.0  # seconds without a write


def search_paths(named: str | None = None, start: str | os.PathLike = ".") -> list[Path]:
    """Folders in which models may lie: the named one, then ``Models`` here and in all folders above."""
    here = Path(start).resolve()
    return [*([Path(named)] if named else []), *(p / "Models" for p in (here, *here.parents))]


def capabilities(folder: str | os.PathLike) -> set[str]:
    """Which of extractor and matcher a folder can run: all files there and none empty."""
    whole = lambda names: all((Path(folder) / n).is_file() and (Path(folder) / n).stat().st_size for n in names)
    return {kind for kind, names in (("extractor", EXTRACTOR), ("matcher", MATCHER)) if whole(names)}


def first_usable(folders: Iterable[str | os.PathLike], needed: Iterable[str] = ("extractor", "matcher")) -> Path | None:
    """The first folder that can run all that is needed."""
    return next((Path(f) for f in folders if set(needed) <= capabilities(f)), None)


def install(chunks: Iterable[bytes], sha256: str, destination: str | os.PathLike, progress: Callable[[str, int], None] = lambda *_: None, needed: Sequence[str] = ("extractor", "matcher")) -> Path:
    """Puts an archive's models at ``destination``, all or nothing.

    The archive is hashed as it comes, unpacked beside the destination, checked, and moved into place by a rename; a former
    set goes only then. Work that others have abandoned is removed.
    """
    destination = Path(destination)
    remove_abandoned(destination)
    work = destination.parent / f".{destination.name}-{uuid.uuid4()}"
    work.mkdir(parents=True)
    try:
        digest, received = hashlib.sha256(), 0
        with open(work / "archive.zip", "wb") as file:
            for chunk in chunks:
                file.write(chunk)
                digest.update(chunk)
                received += len(chunk)
                progress("downloading", received)
        if digest.hexdigest() != sha256.lower():
            raise ValueError("the archive isn't the one that was named")
        progress("extracting", received)
        staged = work / "staged"
        with zipfile.ZipFile(work / "archive.zip") as archive:
            for item in archive.infolist():
                name = Path(item.filename).name
                if not item.is_dir() and name:  # files only, by their own names: nothing leaves the folder
                    staged.mkdir(exist_ok=True)
                    with archive.open(item) as source, open(staged / name, "wb") as target:
                        shutil.copyfileobj(source, target)
        if not set(needed) <= capabilities(staged):
            raise ValueError("the archive lacks models")
        if destination.exists():
            destination.rename(work / "previous")
        staged.rename(destination)
        return destination
    finally:
        shutil.rmtree(work, ignore_errors=True)


def remove_abandoned(destination: str | os.PathLike, now: float | None = None) -> None:
    """Deletes work folders beside ``destination`` that nothing has been written to for long."""
    destination, now = Path(destination), time.time() if now is None else now
    for folder in destination.parent.glob(f".{destination.name}-*"):
        if folder.is_dir() and now - max(p.stat().st_mtime for p in (folder, *folder.iterdir())) > ABANDONED_AFTER:
            shutil.rmtree(folder, ignore_errors=True)


def session(model: bytes, inputs: dict[str, Sequence[int | None]], outputs: dict[str, Sequence[int | None]]):
    """A session of a model whose inputs and outputs have these names and shapes; None stands for any length."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1  # a task has one core
    options.log_severity_level = 3
    made = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
    for wanted, given in ((inputs, made.get_inputs()), (outputs, made.get_outputs())):
        known = {g.name: [n if isinstance(n, int) else None for n in g.shape] for g in given}
        for name, shape in wanted.items():
            own = known.get(name)
            if own is None or len(own) != len(shape) or any(a is not None and b is not None and a != b for a, b in zip(own, shape, strict=True)):
                raise ValueError(f"the model's {name} has shape {own}, not {list(shape)}")
    return made
