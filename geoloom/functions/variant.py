"""Truth and text of JSON values, as a dynamic language would see them.

A value's kind is needed again and again, so paths and kinds are columns of their
own, in projections that the optimizer keeps apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Value:
    """A variant column and its kind: STRING, BOOLEAN, OBJECT, ARRAY, VOID or NUMBER;
    null where the path is missing."""

    value: Column
    kind: Column

    def text(self) -> Column:
        """A scalar as text; null for a JSON null, an object or an array."""
        return F.when(self.kind.isin("STRING", "BOOLEAN", "NUMBER"), F.try_variant_get(self.value, "$", "string"))

    def number(self) -> Column:
        return F.when(self.kind.isin("STRING", "NUMBER"), F.try_variant_get(self.value, "$", "double"))

    def truthy(self) -> Column:
        """Not null, false, 0, '', {} or []; the text '0' is true."""
        return F.coalesce(
            F.when(self.kind == "STRING", F.try_variant_get(self.value, "$", "string") != "")
            .when(self.kind == "NUMBER", F.try_variant_get(self.value, "$", "double") != 0)
            .when(self.kind == "BOOLEAN", F.try_variant_get(self.value, "$", "boolean"))
            .when(self.kind.isin("OBJECT", "ARRAY"), ~F.to_json(self.value).isin("{}", "[]")),
            F.lit(False),
        )

    def present(self) -> Column:
        """Neither missing nor a JSON null."""
        return F.coalesce(self.kind != "VOID", F.lit(False))


def with_values(rows: DataFrame, json: str, paths: dict[str, str]) -> tuple[DataFrame, dict[str, Value]]:
    """Adds the values at these paths of a JSON text, a field or one of its fields; gives them by name.

    The text is read once, and only these fields become variants.  A text that is
    no object, or no JSON, has none of them.
    """
    fields = list(dict.fromkeys(p.partition(".")[0] for p in paths.values()))
    rows = rows.withColumn("_item", F.from_json(json, ", ".join(f"`{x}` variant" for x in fields)))

    def at(path: str) -> Column:
        field, _, inner = path.partition(".")
        value = F.col("_item")[field]
        return F.try_variant_get(value, f"$.{inner}", "variant") if inner else value

    rows = rows.withColumns({f"_v_{n}": at(p) for n, p in paths.items()}).drop("_item")
    rows = rows.withColumns({f"_s_{n}": F.schema_of_variant(f"_v_{n}") for n in paths})

    def kind(n: str) -> Column:
        name = F.col(f"_s_{n}")
        return F.when(name.isin("STRING", "BOOLEAN", "VOID"), name).when(name.startswith("OBJECT"), "OBJECT").when(name.startswith("ARRAY"), "ARRAY").when(name.isNotNull(), "NUMBER")

    rows = rows.withColumns({f"_k_{n}": kind(n) for n in paths})
    return rows, {n: Value(F.col(f"_v_{n}"), F.col(f"_k_{n}")) for n in paths}


def first_truthy(*values: Value) -> Column:
    """The text of the first true value, else that of the last."""
    *early, last = values
    chain = last.text()
    for value in reversed(early):
        chain = F.when(value.truthy(), value.text()).otherwise(chain)
    return chain


def first_present(values: tuple[Value, ...], of) -> Column:
    """``of`` the first value that isn't null."""
    chain = F.lit(None)
    for value in reversed(values):
        chain = F.when(value.present(), of(value)).otherwise(chain)
    return chain
