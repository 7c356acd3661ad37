"""Text forms: stems, label lines, oriented-box lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanmill.functions.boxes import class_id

# The accepted spelling of a number and the token count of a label line.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
LABEL_TOKENS = 8


def frame_stem(sequence: Column, sensor: Column, frame_index: Column) -> Column:
    return F.format_string("%s_%s_%03d", sequence, sensor, frame_index)


def sample_stem(sample_index: Column) -> Column:
    return F.format_string("%07d", sample_index)


def _six(value: Column) -> Column:
    """Half away from zero in double arithmetic. The built-in round asks the shortest decimal form instead, which may lie on the
    other side of a half; it is left for values too large to be scaled, and for those that are no numbers."""
    whole = F.floor(F.abs(value) * 1e6 + 0.5)
    near = F.when(value < 0, -whole).otherwise(whole) / F.lit(1e6)
    return F.when(F.abs(value) < 1e9, near).otherwise(F.round(value, 6))


def six_decimals(*values: Column) -> list[Column]:
    """Rounded first and with -0.0 removed, so the text never reads -0.000000."""
    return [_six(v) + F.lit(0.0) for v in values]


def label_line(x: Column, y: Column, z: Column, length: Column, width: Column, height: Column,
               heading: Column, name: Column) -> Column:
    numbers = six_decimals(x, y, z, length, width, height, heading)
    return F.format_string(" ".join(["%.6f"] * 7) + " %s", *numbers, name)


def obb_line(class_number: Column, corners: list[Column]) -> Column:
    return F.format_string("%d " + " ".join(["%.6f"] * len(corners)), class_number, *six_decimals(*corners))


def parse_label(line: Column) -> Column:
    """Struct of a label line's fields, or null when it is to be skipped.

    Lines without exactly eight tokens are skipped. All seven numbers are read before the
    class is looked at, so a bad number is an error even in a line of an unknown class.
    """
    tokens = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    numbers = F.slice(tokens, 1, 7)
    bad = F.filter(numbers, lambda v: ~v.rlike(NUMBER))
    # The test sits in the class itself, which every reader filters on, so that unused
    # numbers are tested too.
    kind = F.when(
        F.size(bad) > 0, F.raise_error(F.concat(F.lit("bad number in label line: "), line)).cast("int")
    ).otherwise(class_id(F.element_at(tokens, 8)))
    places = {"x": 0, "y": 1, "length": 3, "width": 4, "heading": 6}
    fields = F.struct(
        kind.alias("class_id"), *[numbers[i].try_cast("double").alias(name) for name, i in places.items()]
    )
    return F.when(F.size(tokens) == LABEL_TOKENS, fields)
