"""A tagger as a table function, for SQL: ``SELECT * FROM annotate(TABLE(documents), 'doc_id', 'text', 'lang')``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from mapweave.functions import words
from mapweave.operators.keywords import TOKEN_SCHEMA

_WORD = re.compile(r"[^\W_]+")


def register_annotator(spark: SparkSession, tagger: Callable[[str, str | None], str | None], name: str = "annotate") -> None:
    """Registers ``name`` as a table function that gives the token table of any table of texts.

    ``tagger`` gets a lower-case word and its text's language. The function takes the table, then the names of its id and text columns and,
    optionally, of its language column; names and types are checked while the query is planned. Rows are tagged where they are.
    """
    schema = T._parse_datatype_string(TOKEN_SCHEMA)
    stop_words = {code: frozenset(listed) for code, listed in words.STOP_WORDS.items()}

    class Annotate:
        @staticmethod
        def analyze(texts: AnalyzeArgument, id_column: AnalyzeArgument, text_column: AnalyzeArgument, language_column: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not texts.isTable:
                raise ValueError("the first argument is a table")
            fields = {f.name: f.dataType for f in texts.dataType}
            for argument, kinds in ((id_column, (T.LongType, T.IntegerType)), (text_column, (T.StringType,)), (language_column, (T.StringType,))):
                if argument is not None and not isinstance(fields.get(argument.value), kinds):
                    raise ValueError(f"no column {argument.value!r} of the right type")
            return AnalyzeResult(schema)

        def eval(self, row: T.Row, id_column: str, text_column: str, language_column: str | None = None) -> Iterator[tuple]:
            language = row[language_column] if language_column else None
            stops = stop_words.get(language, stop_words["en"])
            for i, found in enumerate(_WORD.finditer(row[text_column] or "")):
                lemma = found.group().lower()
                yield row[id_column], i, found.start(), found.group(), lemma, tagger(lemma, language), lemma in stops, False

    spark.udtf.register(name, F.udtf(Annotate))
