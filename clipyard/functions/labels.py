"""Names of labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipyard.functions.scalars import capitalised, first_containing, mapped

# Labels and their names.
METHODS = {"real": "Real", "openvoice": "OpenVoice", "seed_vc": "Seed-VC", "cosyvoice": "CosyVoice"}
DIALECTS = {"muntenia": "Muntenia", "transilvania": "Transilvania", "moldova": "Moldova", "rep_moldova": "Rep. Moldova", "maramures": "Maramureș", "oltenia": "Oltenia"}
ENVIRONMENTS = {"itw": "In-the-Wild", "interview": "In-the-Wild", "studio": "Studio"}
SPLITS = {"train": "Train", "val": "Validation", "test_id": "Test (In-Domain)", "test_ood_maramures": "Test OOD (Maramureș)", "test_ood_rep_moldova": "Test OOD (Rep. Moldova)"}
# Fixed values of the statistics on sound, which name dialects by rules of their own: contained text and label, first match; and fewer names.
SOUND_RULES = [("rep_moldova", "rep_moldova"), ("moldova", "moldova"), ("maramures", "maramures"), ("transilvania", "transilvania"), ("ardelean", "transilvania"), ("banat", "banat"), ("oltenia", "oltenia"), ("muntenia", "muntenia"), ("dobrogea", "dobrogea")]
SOUND_DIALECTS = {k: v for k, v in DIALECTS.items() if k != "oltenia"}


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) == ""


def dialect_in(x: Column, first_match: bool = False) -> Column:
    """Name of the dialect whose label the text contains, or the text itself, capitalised. The longest label wins; with first_match the first of the list, for which Rep. Moldova is Moldova."""
    rules = list(DIALECTS.items()) if first_match else sorted(DIALECTS.items(), key=lambda kv: -len(kv[0]))
    return first_containing(x, rules, capitalised(x))


def dialect(field: Column, video: Column, first_match: bool = False) -> Column:
    """By the field where it is filled, or else by the video's name."""
    return F.when(blank(field), dialect_in(video, first_match)).otherwise(mapped(field, DIALECTS, field))


def dialect_of_sound(field: Column, video: Column) -> Column:
    """The same by the rules of the statistics on sound: labels without a name stay, a video that fits no rule is Other."""
    label = F.when(blank(field), first_containing(video, SOUND_RULES, F.lit("Other"))).otherwise(field)
    return mapped(label, SOUND_DIALECTS, label)


def environment(field: Column, video: Column) -> Column:
    wild = F.contains(F.lower(video), F.lit("itw")) | F.contains(F.lower(video), F.lit("interview"))
    return F.when(blank(field), F.when(wild, "In-the-Wild").otherwise("Studio")).otherwise(mapped(field, ENVIRONMENTS, capitalised(field)))


def split(x: Column) -> Column:
    known = F.coalesce(x, F.lit("unknown"))
    return mapped(known, SPLITS, known)


def method(x: Column) -> Column:
    known = F.coalesce(x, F.lit("unassigned"))
    return mapped(known, METHODS, known)
