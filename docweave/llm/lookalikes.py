"""Problem 5: visually identical text with different characters.

Method: DuckDB runs inside the Arrow partitions. Embedded SQL drops invisible characters by regular expression, maps
wide and narrow forms and look-alike letters with translate, composes with nfc_normalize and makes every run of white
space one space. Compatibility forms that read differently (circled digits, powers, units) stay as they are.

Null stays null, empty stays empty. A quote without visible characters is found nowhere.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cyrillic and Greek letters and the Latin letters they look like.
CYRILLIC, CYRILLIC_AS = "АВЕЅІЈКМНОРСТУХԚԜаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXQWaesijopcyxhdqwl"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονρϲϳι", "ABEZHIKMNOPTYXCJovpcji"
OTHER, OTHER_AS = "ɑɡıſ՝‐‑−〜∼∶∕⁄‚", "agis`---~~://,"
# Fixed value: signs that look like the middle dot.
MIDDLE_DOTS = "\u0387\u2027\u2219\u22c5\u30fb\uff65\u318d\u119e"
MIDDLE_DOT = "·"
INVISIBLE = r"[\p{Cf}\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9f}\x{034f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{3164}\x{ffa0}\x{fe00}-\x{fe0f}]"
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}\x{2800}]+"


def alphabet() -> tuple[str, str]:
    """Characters to translate and what they become: the letters above, also with accents, and wide, narrow and styled forms of one character."""
    table = dict(zip(CYRILLIC + GREEK + OTHER + MIDDLE_DOTS, CYRILLIC_AS + GREEK_AS + OTHER_AS + MIDDLE_DOT * len(MIDDLE_DOTS)))
    plain = dict(table)
    for cp in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        form = unicodedata.normalize("NFD", chr(cp))
        if len(form) > 1 and form[0] in plain:
            whole = unicodedata.normalize("NFC", plain[form[0]] + form[1:])
            if len(whole) == 1:
                table[chr(cp)] = whole
    for cp in (*range(0x2100, 0x2150), *range(0xFF00, 0xFFEF), *range(0x1D400, 0x1D800)):
        kind, _, to = unicodedata.decomposition(chr(cp)).partition(" ")
        if kind in ("<wide>", "<narrow>", "<font>") and len(to.split()) == 1 and to != "0020":
            goal = chr(int(to, 16))
            table[chr(cp)] = plain.get(goal, goal)
    return "".join(table), "".join(table.values())


def normalizing_sql(column: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    a, b = map(quoted, alphabet())
    visible = f"regexp_replace({column}, {quoted(INVISIBLE)}, '', 'g')"
    return f"trim(regexp_replace(nfc_normalize(translate({visible}, {a}, {b})), {quoted(SPACE)}, ' ', 'g'))"


def _connection():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})


def _normalized(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    con = _connection()
    made = {c: f"{normalizing_sql(c)} AS {c}" for c in columns}
    for batch in batches:
        part = pa.Table.from_batches([batch])
        con.register("part", part)
        yield from con.sql(f"SELECT {', '.join(made.get(c, c) for c in part.column_names)} FROM part").to_arrow_table().to_batches()


def _found_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _connection()
    test = f"""SELECT rec_kind, rec_id FROM (SELECT rec_kind, rec_id, {normalizing_sql("quote")} AS q, {normalizing_sql("text")} AS t FROM part)
        WHERE q <> '' AND contains(t, q)"""
    for batch in batches:
        part = pa.Table.from_batches([batch])
        con.register("part", part)
        yield from con.sql(test).to_arrow_table().to_batches()


def consistent_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the given text columns in the consistent form."""
    return rows.mapInArrow(lambda it: _normalized(it, columns), rows.schema)


def quotes_of(nodes: DataFrame, goldenset: DataFrame) -> DataFrame:
    return nodes.select(F.lit("node").alias("rec_kind"), F.col("node_no").alias("rec_id"), "chunk_id", F.col("evidence_text").alias("quote")).union(
        goldenset.select(F.lit("goldenset"), "quote_id", "chunk_id", "quote")
    )


def found_only_alike(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """rec_kind, rec_id of quotes that are no substring of their chunk's text but look the same as one."""
    wanted = quotes.select("rec_kind", "rec_id", "chunk_id", "quote").where((F.length("quote") > 0) & F.col("chunk_id").isNotNull())
    texts = chunks.select("chunk_id", "text").where(F.length("text") > 0)
    missed = wanted.join(texts, "chunk_id").where(~F.contains("text", "quote")).select("rec_kind", "rec_id", "quote", "text")
    return missed.mapInArrow(_found_again, "rec_kind string, rec_id long").distinct()
