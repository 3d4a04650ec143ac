"""Bodies of requests against the shape that they must have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a body and their kinds. A tuple lists the values that are allowed; "number?" may be null; all parts must be there.
PAPER = {"title": "string", "abstract": "string", "body": "string", "fields": "strings", "references": "references"}
REVISION = {**PAPER, "revisionSummary": "string"}
COMMENT = {"body": "string", "parentId": "number?"}
REVIEW = {"stance": ("endorse", "challenge", "reject"), "justification": "string"}

_TYPES = {"string": "string", "strings": "array<string>", "number": "double", "number?": "double", "references": "array<struct<citation:string,url:string>>"}
_NUMBERS = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _error(raw: Column, name: str, kind: str | tuple[str, ...]) -> Column:
    """What is wrong with a part; null if nothing is."""
    value = F.try_variant_get(raw, f"$.{name}", "variant")
    type_ = F.schema_of_variant(value)
    there = value.isNotNull() & (type_ != "VOID")

    def told(reason: str) -> Column:
        return F.lit(f"{name}: {reason}")

    missing = F.when(value.isNull(), told("missing"))
    if isinstance(kind, tuple):
        own = F.try_variant_get(raw, f"$.{name}", "string")
        wrong = F.when(type_ != "STRING", told("not a string")).when(~own.isin(*kind), told(f"none of {', '.join(kind)}"))
    elif kind == "string":
        wrong = F.when(type_ != "STRING", told("not a string"))
    elif kind in ("number", "number?"):
        number = type_.rlike(_NUMBERS)
        wrong = F.when(~(number | (F.lit(kind == "number?") & ~there)), told("not a number"))
    elif kind == "strings":
        wrong = F.when(~type_.isin("ARRAY<STRING>", "ARRAY<VOID>") | ~F.coalesce(F.forall(F.try_variant_get(raw, f"$.{name}", "array<string>"), lambda x: x.isNotNull()), F.lit(False)), told("not a list of strings"))
    else:
        items = F.try_variant_get(raw, f"$.{name}", "array<variant>")

        def fine(x: Column) -> Column:
            url = F.try_variant_get(x, "$.url", "variant")
            return F.coalesce((F.schema_of_variant(F.try_variant_get(x, "$.citation", "variant")) == "STRING") & F.schema_of_variant(url).isin("STRING", "VOID"), F.lit(False))

        wrong = F.when(items.isNull() | ~F.coalesce(F.forall(items, fine), F.lit(False)), told("not a list of references"))
    return F.coalesce(missing, wrong)


def checked(bodies: DataFrame, shape: dict[str, str | tuple[str, ...]], body: str = "body") -> DataFrame:
    """bodies with request, the parts as a struct, and errors array<string>: what a request is refused for (400), empty if it is not.

    A part of a wrong kind or one that is missing is an error, not a null; parts that the shape does not name are ignored.
    """
    raw = F.try_parse_json(F.col(body))
    is_object = F.coalesce(raw.isNotNull() & F.trim(F.col(body)).startswith("{"), F.lit(False))
    parts = F.array_compact(F.array(*[_error(raw, name, kind) for name, kind in shape.items()]))
    errors = F.when(is_object, parts).otherwise(F.array(F.lit("body: no JSON object")))
    ddl = ", ".join(f"{name} {_TYPES['string' if isinstance(kind, tuple) else kind]}" for name, kind in shape.items())
    return bodies.withColumn("errors", errors).withColumn("request", F.from_json(F.when(is_object, F.col(body)), ddl))
