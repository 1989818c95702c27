"""The numeric core of image ingestion on pixel arrays, and the tags that may be kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags that say nothing about a person, and the columns they become.
TAGS = {
    "Modality": "modality",
    "BodyPartExamined": "body_part",
    "ViewPosition": "view_position",
    "PatientPosition": "patient_position",
    "Rows": "rows",
    "Columns": "columns",
    "PhotometricInterpretation": "photometric_interpretation",
    "BitsStored": "bits_stored",
    "WindowCenter": "window_center",
    "WindowWidth": "window_width",
    "RescaleIntercept": "rescale_intercept",
    "RescaleSlope": "rescale_slope",
    "SliceThickness": "slice_thickness",
    "KVP": "kvp",
    "Manufacturer": "manufacturer",
}


def windowed(pixels: Column, slope: Column | None = None, intercept: Column | None = None, center: Column | None = None, width: Column | None = None) -> Column:
    """Stored values as 0..255: rescaled, then cut to the window, or to the values' own range without one."""
    none = F.lit(None).cast("double")
    slope = F.coalesce(F.nullif(slope if slope is not None else none, F.lit(0.0)), F.lit(1.0))
    intercept = F.coalesce(intercept if intercept is not None else none, F.lit(0.0))
    center, width = (x if x is not None else none for x in (center, width))
    real = F.transform(pixels, lambda p: p.cast("double") * slope + intercept)
    usable = center.isNotNull() & (width > 0)
    low = F.when(usable, center - width / 2).otherwise(F.array_min(real))
    high = F.when(usable, center + width / 2).otherwise(F.array_max(real))
    high = F.when(high <= low, low + 1).otherwise(high)
    return F.transform(real, lambda p: (F.least(F.greatest((p - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))


def middle(frames: Column) -> Column:
    """The frame that is shown of several: the middle one, the later of two."""
    return F.try_element_at(frames, (F.size(frames) / 2).cast("int") + 1)


def shown(levels: Column, photometric: Column) -> Column:
    """Inverted where the least value is white."""
    return F.when(photometric == "MONOCHROME1", F.transform(levels, lambda p: 255 - p)).otherwise(levels)


def allowed(tags: Column) -> Column:
    """The allowed tags of a map, under their column names."""
    kept = F.map_filter(tags, lambda k, v: k.isin(*TAGS) & v.isNotNull())
    names = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    return F.transform_keys(kept, lambda k, v: names[k])


def study_year(date: Column) -> Column:
    """The first day of the study's year; null outside 1900 to 2100."""
    year = F.left(date, F.lit(4)).try_cast("int")
    return F.when(year.between(1900, 2100), F.make_date(year, F.lit(1), F.lit(1)))


def is_dicom(content: Column, name: Column) -> Column:
    """By the mark at byte 128, else by extension."""
    mark = (F.length(content) > 132) & (F.substr(content, F.lit(129), F.lit(4)) == F.lit(b"DICM"))
    return F.coalesce(mark, F.lit(False)) | F.lower(name).rlike(r"\.(dcm|dicom)$")


def mean_confidence(confidences: Column) -> Column:
    """The mean of the word confidences that are known, to one digit; 0 without any."""
    known = F.filter(confidences, lambda c: c >= 0)
    total = F.aggregate(known, F.lit(0.0), lambda s, c: s + c)
    return F.when(F.size(known) > 0, F.round(total / F.size(known), 1)).otherwise(0.0)
