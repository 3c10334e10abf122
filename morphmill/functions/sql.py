"""The library's functions for SQL text: normalisation and pre-tokenization, and with a model encoding, decoding and a table function.

What is built of Spark's own expressions is registered as SQL functions, which
Spark puts into the query's plan; only segmentation and decoding are Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from morphmill.functions.text import SPACE, pretokenizer_pattern
from morphmill.model import SEQUENCE, Model
from morphmill.operators.encode import ENCODED, IDS, in_hex, joined_pieces, segmenter


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, model: Model | None = None) -> list[str]:
    """Register temporary functions; their names.

    ``normalize_line(text)``, ``pretokenize(text, cut)``; with a model, of its own
    normaliser: ``encode_pieces(text)`` (array of piece and id), ``encode_ids(text)``,
    ``encode_hex(text)`` (a string of pieces, ``<hexadecimal>`` each), ``decode_ids(ids)``, and the table function ``pieces_of(text)`` (pos, piece, id).
    Nulls give nulls, and no rows.
    """
    names = ["normalize_line", "pretokenize"]
    space = _literal(SPACE)

    def merged(x: str, space: str = space) -> str:
        return f"trim(TRAILING {space} FROM regexp_replace(trim(LEADING ' ' FROM {x}), ' +', {space}))"

    cuts = " ".join(f"WHEN {k} THEN regexp_extract_all(x, {_literal(pretokenizer_pattern(k))}, 0)" for k in (0, 1))
    statements = [
        f"normalize_line(x STRING) RETURNS STRING RETURN {merged('x')}",
        f"pretokenize(x STRING, cut INT) RETURNS ARRAY<STRING> RETURN CASE cut {cuts} END",
    ]
    if model is not None:
        n = model.normalizer
        if n.name:
            raise ValueError("a model with a named Unicode normaliser is for the Column functions")
        mark = _literal(n.space or SPACE)

        def encoded(x: str, by: str = "_segmented") -> str:
            text = x if model.spec.method == SEQUENCE else f"replace({x}, ' ', {mark})" if n.reconstruct else merged(x, mark)
            return f"CASE WHEN {x} IS NOT NULL THEN {by}(array({text})) END"

        spark.udf.register("_segmented", segmenter(model, ENCODED))
        spark.udf.register("_ids", segmenter(model, IDS))
        spark.udf.register("_hex", segmenter(model, "string", False, in_hex))
        spark.udf.register("_joined", joined_pieces(model))
        back = "make_valid_utf8(CAST(_joined(ids) AS STRING))"
        back = back if model.spec.method == SEQUENCE else f"replace({back}, {mark}, ' ')"
        statements += [
            f"encode_pieces(x STRING) RETURNS ARRAY<STRUCT<piece: BINARY, id: INT>> RETURN {encoded('x')}",
            f"encode_ids(x STRING) RETURNS ARRAY<INT> RETURN {encoded('x', '_ids')}",
            f"encode_hex(x STRING) RETURNS STRING RETURN {encoded('x', '_hex')}",
            f"decode_ids(ids ARRAY<INT>) RETURNS STRING RETURN {back}",
            # a generator over the argument alone, which Spark turns into one beside the rows; over a sub-query it would join with all different texts
            f"pieces_of(x STRING) RETURNS TABLE(pos INT, piece BINARY, id INT) RETURN SELECT t.pos, t.p.piece, t.p.id FROM posexplode({encoded('pieces_of.x')}) AS t(pos, p)",
        ]
        names += ["encode_pieces", "encode_ids", "encode_hex", "decode_ids", "pieces_of"]
    for s in statements:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {s}")
    return names

