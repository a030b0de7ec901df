"""A table function that finds what a language server doesn't see, by the language of each row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from graphmill.sources.texts import c_macros

#: What every provider's rows have, beside the key of the source.
COMMON = "name string, kind string, start_line int, end_line int"


@dataclass(frozen=True)
class Provider:
    """Rows for a source: COMMON's values and those of its own columns, as dictionaries."""

    columns: str
    rows: Callable[[str], Iterator[dict]]


def macro_rows(source: str) -> Iterator[dict]:
    for m in c_macros(source):
        yield {"name": m["name"], "kind": "macro", "start_line": m["line"], "end_line": m["end_line"], "conditions": m["conditions"], "value": m["value"]}


MACROS = Provider("conditions array<string>, value string", macro_rows)

#: Languages with a provider; others give no rows.
PROVIDERS = {"c": MACROS, "cpp": MACROS}


def register(spark: SparkSession, providers: dict[str, Provider] | None = None, name: str = "language_supplements") -> None:
    """Register the function `name(TABLE(t))` or `name(TABLE(t), 'c, cpp')` over tables with columns id, language
    and source.

    The schema comes from the call: id of the table's type, language, COMMON and the columns of the providers of
    the languages that it names, or of all. Rows of other languages, and null sources, give nothing. Two providers
    that name a column must agree on its type."""
    own = dict(PROVIDERS if providers is None else providers)
    common = T.StructType.fromDDL(COMMON).fields  # DDL is parsed here, as workers can't
    fields = {x: [*common, *(T.StructType.fromDDL(p.columns).fields if p.columns else [])] for x, p in own.items()}

    def chosen(languages: str | None) -> dict[str, Provider]:
        if languages is None:
            return own
        names = [x.strip() for x in languages.split(",")]
        unknown = [x for x in names if x not in own]
        if unknown:
            raise ValueError(f"no provider for {', '.join(unknown)}")
        return {x: own[x] for x in names}

    class Supplements:
        @staticmethod
        def analyze(table: AnalyzeArgument, languages: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("the first argument must be a table")
            have = {f.name: f.dataType for f in table.dataType.fields}
            missing = [c for c in ("id", "language", "source") if c not in have]
            if missing:
                raise ValueError(f"the table lacks {', '.join(missing)}")
            if languages is not None and (not languages.isConstantExpression or languages.value is None):
                raise ValueError("languages must be a constant")
            schema = T.StructType([T.StructField("id", have["id"]), T.StructField("language", T.StringType())])
            kinds: dict[str, T.DataType] = {}
            for f in (f for x in chosen(languages.value if languages else None) for f in fields[x]):
                if kinds.setdefault(f.name, f.dataType) != f.dataType:
                    raise ValueError(f"two types for {f.name}")
            for n, kind in kinds.items():
                schema = schema.add(n, kind)
            return AnalyzeResult(schema=schema)

        def eval(self, row: Row, languages: str | None = None):
            use = chosen(languages)
            provider = use.get(row["language"])
            if provider is not None and row["source"] is not None:
                names = dict.fromkeys(f.name for x in use for f in fields[x])
                for got in provider.rows(row["source"]):
                    yield (row["id"], row["language"], *(got.get(n) for n in names))

    spark.udtf.register(name, udtf(Supplements))
