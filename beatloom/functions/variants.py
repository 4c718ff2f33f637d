"""Reading loose JSON held in VARIANT columns.

A missing key is SQL NULL, an explicit JSON null is a variant null: ``coalesce`` over keys is
therefore a "first key that exists" test, in which a JSON null shadows later aliases.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatloom import constants as K
from beatloom.functions.arrays import keep_spaced, let, only
from beatloom.functions.scalars import col


def get(v, *path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(col(v), "$" + "".join(f".{p}" for p in path), as_type)


def kind(v) -> Column:
    """First word of the variant's type: OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number type."""
    return F.regexp_extract(F.schema_of_variant(col(v)), "^[A-Z]+", 0)


def is_object(v) -> Column:
    return F.coalesce(kind(v) == "OBJECT", F.lit(False))


def is_array(v) -> Column:
    return F.coalesce(kind(v) == "ARRAY", F.lit(False))


def obj(v, *path: str) -> Column:
    """The value at a path when it is an object."""
    x = get(v, *path)
    return F.when(is_object(x), x)


def first_present(v, keys: list[str]) -> Column:
    """Value of the first key that exists, a JSON null included."""
    return F.coalesce(*[get(v, k) for k in keys])


def number(v) -> Column:
    """Number or numeric string as double; booleans and objects give null."""
    v = col(v)
    return F.when(~kind(v).isin("BOOLEAN", "OBJECT", "ARRAY", "VOID"), F.try_variant_get(v, "$", "double"))


def integer(v) -> Column:
    """Number cut to an integer, or an integer string."""
    v = col(v)
    k = kind(v)
    text = F.try_variant_get(v, "$", "string")
    return F.when(k == "STRING", F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))).when(
        ~k.isin("BOOLEAN", "OBJECT", "ARRAY", "VOID"), F.try_variant_get(v, "$", "double").cast("long")
    )


def text(v) -> Column:
    """String values only."""
    return F.when(kind(v) == "STRING", F.try_variant_get(col(v), "$", "string"))


def scalar_text(v) -> Column:
    """String, number or boolean as text; numbers print as doubles."""
    v = col(v)
    k = kind(v)
    return F.when(k.isin("STRING", "BOOLEAN"), F.try_variant_get(v, "$", "string")).when(
        ~k.isin("OBJECT", "ARRAY", "VOID"), F.try_variant_get(v, "$", "double").cast("string")
    )


def flag(v) -> Column:
    """Booleans, numbers, and the words true/1/yes and false/0/no."""
    v = col(v)
    k = kind(v)
    word = F.lower(F.try_variant_get(v, "$", "string"))
    return (
        F.when(k == "STRING", F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False))
        .when(k.isin("OBJECT", "ARRAY", "VOID"), F.lit(None).cast("boolean"))
        .otherwise(F.try_variant_get(v, "$", "boolean"))
    )


def items(v) -> Column:
    """Elements of an array variant, null for anything else."""
    return F.try_variant_get(col(v), "$", "array<variant>")


def _first_of(candidates: list[Column], rule) -> Column:
    """First non-null result of a rule over candidate values; the rule is planned once."""
    return F.get(F.filter(F.transform(F.array(*candidates), rule), lambda x: x.isNotNull()), F.lit(0))


def timing_value(v) -> Column:
    """Seconds in a number, numeric string or one of the object shapes (P5)."""
    v = col(v)
    nested = [first_present(get(v, p), K.TIMING_NESTED_KEYS) for p in K.TIMING_NESTED_PARENTS]
    return _first_of([v, first_present(v, K.TIMING_DIRECT_KEYS), *nested], number)


def timing_values(v) -> Column:
    """All times of an array, else the single time of a value, else an empty array."""
    v = col(v)
    return F.array_compact(F.transform(F.coalesce(items(v), F.array(v)), timing_value))


def _flatten_label(v: Column) -> Column:
    return F.when(scalar_text(v).isNotNull(), v).otherwise(first_present(v, K.LABEL_NESTED_KEYS))


def lane_value(at, keys: list[str] | None = None) -> Column:
    """Label of a hit: direct keys first, then nested objects.

    ``at`` maps a key to the hit's value under it, see :func:`reader`. A nested object whose
    label is unusable ends the search, like a direct one.
    """
    direct = F.coalesce(*[at(k) for k in (keys or K.LABEL_KEYS)])
    nested = [first_present(at(p), K.LABEL_NESTED_KEYS) for p in K.LABEL_NESTED_PARENTS]
    # a direct label settles the matter even when it holds nothing usable
    return F.get(
        F.transform(F.filter(F.array(direct, F.coalesce(*nested)), lambda x: x.isNotNull()), _flatten_label), F.lit(0)
    )


def reader(outer, inner=None):
    """Key lookup in a hit; keys of a wrapped inner object win over the outer ones."""
    if inner is None:
        return lambda key: get(outer, key)
    return lambda key: F.coalesce(get(inner, key), get(outer, key))


def normalize_starts(times: str) -> Column:
    """W19 on the array of one document, a column by name: sorted, non-negative, finite, no near repeats."""
    usable = only(times, lambda x: f"{x} >= 0 and not isnan({x}) and {x} != double('Infinity')")
    return F.expr(let(f"array_sort({usable})", lambda t: keep_spaced(t, K.TIME_TOLERANCE)))
