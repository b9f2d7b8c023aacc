"""Which files a corpus folder (its published version, if it has one) and an arm's folder hold for a pass."""

from __future__ import annotations

import re
from pathlib import Path

from .jsonl import InputError
from .store import resolve

#: The forms of file names, by pass.
GOLDEN_NAMES = {"main": r"golden\.[^.]+\.jsonl", "probe": r"golden\.[^.]+\.probe\.jsonl"}
REPEAT_NAMES = r"predictions\.repeat-\d+\.jsonl"


def golden_files(corpora: str | Path, run_pass: str = "main") -> list[str]:
    """Golden files of all classes, by name; those of probes lie in ``probes``.  None at all is an error."""
    folder = resolve(corpora) / ("probes" if run_pass == "probe" else "")
    found = sorted(p.name for p in folder.iterdir() if re.fullmatch(GOLDEN_NAMES[run_pass], p.name)) if folder.is_dir() else []
    if not found:
        raise InputError(f"{folder}: no golden files of the {run_pass} pass")
    return [str(folder / name) for name in found]


def prediction_files(arm: str | Path, run_pass: str = "main") -> list[str]:
    """Files of single repeats, by class and repeat; copies under other names don't count.  None at all is an error."""
    found = [p for p in Path(arm).glob(f"*/{run_pass}/*") if re.fullmatch(REPEAT_NAMES, p.name)]
    if not found:
        raise InputError(f"{arm}: no predictions of single repeats in the {run_pass} pass")
    return [str(p) for p in sorted(found, key=lambda p: (p.parts[-3], p.name))]


def class_schemas(corpora: str | Path) -> dict[str, Path]:
    """Schema file of each class that has a golden file; a class without one is an error."""
    out = {}
    for path in golden_files(corpora):
        name = Path(path).name.split(".")[1]
        out[name] = resolve(corpora) / f"{name}.schema.json"
        if not out[name].is_file():
            raise InputError(f"{out[name]}: no schema for class {name}")
    return out
