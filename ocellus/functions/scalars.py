"""Scalar expressions: identifiers, coercions, scores, moments, feature names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grades of the ordinal scale.
GRADE_NAMES = {0: "No DR", 1: "Mild NPDR", 2: "Moderate NPDR", 3: "Severe NPDR", 4: "Proliferative DR"}
LABELS = tuple(GRADE_NAMES)
#: Suffixes of image files; those that an identifier loses are one fewer.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".jpe", ".tif", ".tiff", ".bmp", ".ppm")
STRIPPED = r"\.(png|jpe?g|tiff?|bmp|ppm)$"


def stem(path: Column) -> Column:
    """Lower-cased file name without folders and last suffix."""
    return F.lower(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))


def is_image(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in IMAGE_SUFFIXES) + ")$")


def normal_id(value: Column) -> Column:
    """Trimmed, lower-cased, without an image suffix."""
    return F.regexp_replace(F.lower(F.trim(value.cast("string"))), STRIPPED, "")


def derive_group(image_id: Column, regex: str | None) -> Column:
    """The first group that ``regex`` finds at the start (any case), or the whole match; the id itself without a match."""
    if not regex:
        return image_id
    import re

    index = 1 if re.compile(regex).groups else 0
    anchored = f"(?i)^(?:{regex})"
    return F.when(image_id.rlike(anchored), F.regexp_extract(image_id, anchored, index)).otherwise(image_id)


def finite(value: Column, default: float = 0.0) -> Column:
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v)


def grade_label(grade: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in GRADE_NAMES.items() for x in kv])
    return F.concat_ws(" - ", grade.cast("string"), F.coalesce(names[grade], F.lit("unknown")))


def referable(grade: Column, threshold: int = 2) -> Column:
    return (grade >= threshold).cast("int")


def refer(score: Column, threshold: float | None) -> Column | None:
    """The decision column; none where the threshold is unknown."""
    if threshold is None or math.isnan(threshold):
        return None
    return (score >= threshold).cast("int")


def cut(score: Column, thresholds: list[float] | Column) -> Column:
    """Class of a score: how many thresholds lie strictly below it."""
    t = thresholds if isinstance(thresholds, Column) else F.array(*[F.lit(float(x)) for x in thresholds])
    return F.size(F.filter(t, lambda x: x < score))


def expected_class(probability: Column, classes: tuple[int, ...] = LABELS) -> Column:
    """Sum of class times probability."""
    weights = F.array(*[F.lit(float(c)) for c in classes])
    return F.aggregate(F.zip_with(probability, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def softmax_class(decision: Column, classes: tuple[int, ...] = LABELS) -> Column:
    """Expected class under the softmax of decision values."""
    top = F.array_max(decision)
    e = F.transform(decision, lambda x: F.exp(x - top))
    return expected_class(e, classes) / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)


#: Descriptor families and what they measure.
FAMILIES = {
    "colour": "pigmentation and white balance inside the field of view",
    "exposure": "contrast, dynamic range and sharpness",
    "vessel": "vascular tree: area, length, branching, complexity",
    "lesion": "bright and dark lesion burden",
    "disc": "optic disc position and contrast",
    "macula": "macular darkness",
    "texture": "grey-level co-occurrence, local binary patterns, entropy",
    "zone": "centre-to-periphery intensity profile",
}


def feature_family(name: Column) -> Column:
    head = F.split(name, "_")[0]
    known = F.when(head.startswith("zone"), "zone").when(head.isin(*FAMILIES), head)
    return F.coalesce(known, F.lit("other"))


def describe_feature(name: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    return F.coalesce(texts[feature_family(name)], F.lit("image descriptor"))


def moments(x: str) -> dict[str, Column]:
    """Mean, population deviation, biased skewness and biased excess kurtosis."""
    return {"mean": F.avg(x), "std": F.stddev_pop(x), "skew": F.skewness(x), "kurt": F.kurtosis(x)}


def signature(*settings: Column, digits: int = 12) -> Column:
    """First hex digits of the SHA-1 of settings as JSON."""
    return F.substring(F.sha1(F.to_json(F.struct(*settings))), 1, digits)
