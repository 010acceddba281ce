"""Fill-in-the-middle examples, cut by DuckDB inside mapInArrow.

Each batch of texts is registered in an in-memory DuckDB of its task, which cuts the texts into
units with ``regexp_extract_all``, draws the cuts and the form from ``sha256`` of the document's
id, slices and joins the units, and returns Arrow; no row passes through Python. The draw depends
on nothing but the id and the seed, so a task that runs again gives the same.

Null texts are empty; an empty text and one that holds a marker stay plain. A null id is drawn as
the empty string is. Repeated rows give equal rows. Texts of any length are cut whole, a batch is
at most ``SLICE`` bytes or one text. The result is one struct beside the columns of the input,
which keep their names and values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from estimark.llm.common import text_slices

#: Bytes of text that DuckDB gets at once.
SLICE = 2 << 20
#: A unit; the markers of prefix, suffix and middle.
UNIT, P, S, M = "[A-Za-z]+|[^A-Za-z]", "<P>", "<S>", "<M>"
SETTINGS = {"threads": "1", "temp_directory": "", "autoinstall_known_extensions": "false", "autoload_known_extensions": "false"}


def shaped(source: str, seed: str, plain_from: int, spm_below: int) -> str:
    """SQL for (place, n, form, prefix_chars, middle_chars, output) of a table (place, id, text)."""
    draw = lambda i: f"('0x' || substr(h, {8 * i - 7}, 8))::UBIGINT"
    return f"""
WITH units AS (
  SELECT place, text, regexp_extract_all(text, '{UNIT}') AS u, sha256('{seed}:' || id) AS h FROM {source}),
drawn AS (
  SELECT place, text, u, len(u) AS n, {draw(1)} % (len(u) + 1)::UBIGINT AS x, {draw(2)} % (len(u) + 1)::UBIGINT AS y,
    CASE WHEN text = '' OR contains(text, '{P}') OR contains(text, '{S}') OR contains(text, '{M}') OR {draw(3)} % 100 >= {plain_from} THEN 'plain'
      WHEN {draw(4)} % 100 < {spm_below} THEN 'spm' ELSE 'psm' END AS form FROM units),
cut AS (
  SELECT place, text, n, form,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, least(x, y)::BIGINT), '') END AS prefix,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, least(x, y)::BIGINT + 1, greatest(x, y)::BIGINT), '') END AS middle,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, greatest(x, y)::BIGINT + 1, n), '') END AS suffix FROM drawn)
SELECT place, n::BIGINT AS n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{P}' || prefix || '{S}' || suffix || '{M}' || middle
    ELSE '{S}' || suffix || '{P}' || prefix || '{M}' || middle END AS output FROM cut"""


def rebuilt() -> str:
    """SQL for the text that ``output`` and ``form`` were made of."""
    between = lambda a, b: f"split_part(split_part(output, '{a}', 2), '{b}', 1)"
    return f"""CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN {between(P, S)} || split_part(output, '{M}', 2) || {between(S, M)}
    ELSE {between(P, M)} || split_part(output, '{M}', 2) || {between(S, P)} END"""


def in_duckdb(docs: DataFrame, sql: str, fields: str, doc_id: str, text: str, keep: list[str], found: str) -> DataFrame:
    """The columns ``keep`` and a struct of what ``sql`` makes of the table ``batch`` (place, id, text)."""
    clear = lambda name: F.col(f"`{name}`")
    rows = docs.select(F.coalesce(clear(doc_id).cast("string"), F.lit("")).alias("id"), F.coalesce(clear(text), F.lit("")).alias("text"), F.struct(*[clear(c) for c in keep]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config=SETTINGS) as con:
            for batch in text_slices(batches, SLICE):
                table = pa.table({"place": pa.array(range(batch.num_rows), pa.int64()), "id": batch.column("id"), "text": batch.column("text")})
                con.register("batch", table)
                made = con.sql(f"SELECT * FROM ({sql}) ORDER BY place").to_arrow_table().drop_columns("place").combine_chunks()
                con.unregister("batch")
                columns = [x.cast(pa.int64() if pa.types.is_integer(x.type) else pa.string()).combine_chunks() for x in made.columns]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.StructArray.from_arrays(columns, made.column_names)], ["row", "found"])

    made = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("found", StructType.fromDDL(fields))]))
    return made.select(*[F.col(f"row.`{c}`") for c in keep if c != found], F.col("found").alias(found))


def examples(docs: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20, doc_id: str = "doc_id", text: str = "text", found: str = "fim") -> DataFrame:
    """The columns of ``docs`` and a struct ``found`` (n, form, prefix_chars, middle_chars, output);
    a column of that name in ``docs`` is replaced."""
    fields = "n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string"
    return in_duckdb(docs, shaped("batch", seed, plain_from, spm_below), fields, doc_id, text, docs.columns, found)


def digests(docs: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): digests of the
    outputs, and of the texts rebuilt from output and form."""
    fields = "n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output_sha256: string, restored_sha256: string"
    sql = f"""SELECT place, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({rebuilt()}) AS restored_sha256
FROM ({shaped("batch", seed, plain_from, spm_below)})"""
    return in_duckdb(docs, sql, fields, doc_id, text, [doc_id], "found").select(F.col(f"`{doc_id}`").alias("doc_id"), "found.*")
