"""Known cohorts: how their label files name things, and how an image's name tells its patient."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from ocellus.operators.manifest import LabelJoinError


@dataclass(frozen=True)
class Adapter:
    """Candidate columns in order of preference, usual label files, and the pattern of a patient in an image's name."""

    name: str
    id_columns: tuple[str, ...]
    label_columns: tuple[str, ...]
    label_files: tuple[str, ...] = ()
    group_regex: str | None = None

    @staticmethod
    def find(columns: list[str], candidates: tuple[str, ...]) -> str | None:
        """The first candidate that is there, whatever the case and outer spaces."""
        there = {c.strip().lower(): c for c in reversed(columns)}
        return next((there[c.strip().lower()] for c in candidates if c.strip().lower() in there), None)


#: Column names, file names and name patterns of the public data sets.
ADAPTERS = {
    a.name: a
    for a in (
        Adapter("aptos", ("id_code", "image", "image_id", "id"), ("diagnosis", "level", "grade", "dr_grade"), ("train.csv", "train_1.csv")),
        Adapter("eyepacs", ("image", "id_code", "image_id"), ("level", "diagnosis", "grade"), ("trainLabels.csv", "trainLabels_cropped.csv"), r"^(\d+)_(?:left|right)$"),
        Adapter("messidor2", ("image_id", "image", "id", "id_code"), ("adjudicated_dr_grade", "dr_grade", "retinopathy grade", "grade", "diagnosis"), ("messidor_data.csv", "messidor-2.csv"), r"^(.*?)_[A-Za-z]*\d*$"),
        Adapter("idrid", ("image name", "image_name", "image", "id_code"), ("retinopathy grade", "grade", "dr_grade", "diagnosis"), ("IDRiD_Disease_Grading_Training_Labels.csv", "a. IDRiD_Disease Grading_Training Labels.csv")),
        Adapter("generic", ("image_id", "id_code", "image", "filename", "file", "name", "id"), ("grade", "diagnosis", "level", "label", "dr_grade", "class"), ("labels.csv",)),
        Adapter("synthetic", ("image_id",), ("grade",), ("labels.csv",), r"^(P\d+)_(?:left|right)$"),
    )
}


def locate_labels(explicit: str | None, adapter: Adapter, roots: list[Path]) -> Path:
    """The named file, else a usual one below the roots, else the only CSV there."""
    if explicit:
        if not Path(explicit).is_file():
            raise LabelJoinError(f"no label file at {explicit}")
        return Path(explicit)
    for root in roots:
        for name in adapter.label_files:
            if (root / name).is_file():
                return root / name
    found = sorted({p for root in roots if root.is_dir() for p in root.glob("*.csv")})
    if len(found) != 1:
        raise LabelJoinError(f"{len(found)} CSV files below {', '.join(map(str, roots))}; name one")
    return found[0]
