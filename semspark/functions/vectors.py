"""Vector arithmetic on array columns, in doubles."""

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW = 16


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products from the left; vectors of different length are an error."""
    product = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors differ in length"))))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two maps of slots to values."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at(b, e["key"]), F.lit(0.0)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_of(product: Column, norm_a: Column, norm_b: Column, strict: bool = True) -> Column:
    """Cosine from a dot product and norms, within [-1, 1].  A zero norm is an error, or null where not strict."""
    length = norm_a * norm_b
    # least and greatest pass over nulls, so a null must not reach them
    value = F.when(length != 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(product, length))))
    return F.when(length == 0, F.raise_error(F.lit("a zero vector has no cosine"))).otherwise(value) if strict else value


def cosine(a: Column, b: Column, strict: bool = True) -> Column:
    return cosine_of(dot(a, b), norm(a), norm(b), strict)


def distance(similarity: Column) -> Column:
    return 1 - similarity


def dimension(v: Column) -> Column:
    return F.size(v)


def preview(v: Column, n: int = PREVIEW) -> Column:
    """The first values."""
    return F.slice(doubles(v), 1, n)


def vector_json(v: Column) -> Column:
    """JSON text of all values, floats widened to doubles."""
    return F.to_json(doubles(v))


def l2_normalize(v: Column) -> Column:
    """Divided by the norm; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / length))


def first_vector(nested: Column) -> Column:
    """The first row of a matrix."""
    return F.element_at(nested, 1)
