"""Column builders shared by operators: hash random numbers, vectors, null handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on `parts` only, equal in every engine that has MD5."""
    cols = [F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p for p in parts]
    digest = F.md5(F.concat_ws("|", *(c.cast("string") for c in cols)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    product = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(product == 0, F.lit(0.0)).otherwise(dot(a, b) / product)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cityblock(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def falsy(*cols: Column) -> Column:
    """The first value that is neither null nor empty; an empty string if there is none."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(""))


def no_nan(c: Column) -> Column:
    """Null in place of NaN."""
    return F.when(F.isnan(c), None).otherwise(c)


def ladder(value: Column, edges: Sequence[tuple[float, str]], above: str) -> Column:
    """Label of the first edge that is not below `value` (bins closed on the right)."""
    out = None
    for edge, name in edges:
        out = F.when(value <= edge, name) if out is None else out.when(value <= edge, name)
    return out.otherwise(above)


def human_size(c: Column) -> Column:
    """Bytes with one decimal and the largest fitting binary unit."""
    shown = lambda x, unit: F.format_string(f"%.1f {unit}", F.round(x, 1))
    out = F.when(c < 1024, shown(c.cast("double"), "B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = out.when(c < 1024 ** (power + 1), shown(c / 1024.0**power, unit))
    return out.otherwise(shown(c / 1024.0**4, "TB"))
