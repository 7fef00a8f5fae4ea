"""Discourse moves of a text in one pass over Arrow strings: a row per text, nothing shuffled. Patterns run in RE2, as in the SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from inkstone.functions import markers as M
from inkstone.functions.text import MARK
from inkstone.plans.catalogue import builder
from inkstone.sources.tables import table

ROWS = 256
FOUND = [*M.MOVES, "unmarked"]
_FIRST = "(?i)" + "|".join(f"(?P<{move}>{'|'.join(f'(?:{p})' for p in patterns)})" for move, patterns in M.MOVES.items())


def marked(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, d_<move>: markers of each move, and c_<move>: sentences whose first marker is of it, of texts with words."""
    out = {"n_words": pc.count_substring_regex(texts, r"\w+").to_numpy().astype(np.int64)}
    for move, patterns in M.MOVES.items():
        out[f"d_{move}"] = sum(pc.count_substring_regex(texts, f"(?i){p}").to_numpy().astype(np.int64) for p in patterns)
    parts = pc.split_pattern(pc.replace_substring_regex(texts, r"""([.!?])\s+([A-Z"“(])""", rf"\1{MARK}\2"), MARK)
    sents, of = parts.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
    sents = pc.utf8_trim(sents, " ")
    said = pc.match_substring_regex(sents, r"\S").to_numpy(zero_copy_only=False)
    first = pc.extract_regex(sents, _FIRST)
    left = said.copy()
    for k, move in enumerate(M.MOVES):
        has = left & pc.greater(pc.binary_length(pc.struct_field(first, [k])), 0).fill_null(False).to_numpy(zero_copy_only=False)
        out[f"c_{move}"] = np.bincount(of[has], minlength=len(texts))
        left &= ~has
    out["c_unmarked"] = np.bincount(of[left], minlength=len(texts))
    return out


COLUMNS = ["n_words", *(f"d_{m}" for m in M.MOVES), *(f"c_{m}" for m in FOUND)]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            ids, texts = batch.slice(low, ROWS).columns
            texts = pc.replace_substring_regex(texts, M.BEYOND_ASCII, "_")
            worded = pc.match_substring_regex(texts, r"\w")
            ids, found = ids.filter(worded), marked(texts.filter(worded))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[c], pa.int64()) for c in COLUMNS)], ["doc_id", *COLUMNS])


@builder("move_counts", "")  # Spark alone reads it
def _move_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return docs.mapInArrow(_marked, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS))
