"""Passages of known texts within documents, by one Aho-Corasick automaton over their word windows.

After Aho and Corasick (1975).  Words are numbered; the patterns are all runs of
``n`` words of the items.  Each whole document is read once from
its first word to its last, whatever number of items there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm import wikitext

#: Words in a row that make a passage.
N_WORDS = 13
#: Most items that one automaton holds.
MOST_ITEMS = 20_000

_built: dict = {}


def automaton(items: tuple[tuple[int, str], ...], n: int):
    """(numbers of words, automaton, or None without any window); a window that several items share brings all of them."""
    if (items, n) not in _built:
        import ahocorasick

        _built.clear()
        number: dict[str, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [number.setdefault(w, len(number) + 1) for w in wikitext.words(text)]
            for k in range(len(ids) - n + 1):
                windows.setdefault(tuple(ids[k : k + n]), set()).add(item)
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, found in windows.items():
            machine.add_word(window, tuple(found))
        if windows:
            machine.make_automaton()
        _built[items, n] = number, machine if windows else None
    return _built[items, n]


def found_in(text: str, items: tuple[tuple[int, str], ...], n: int = N_WORDS) -> dict[int, int]:
    """For each item with a passage in ``text``, the number of the word at which its first one starts."""
    number, machine = automaton(items, n)
    out: dict[int, int] = {}
    if machine is not None:
        ids = tuple([number.get(w, 0) for w in wikitext.words(text)])
        if len(ids) >= n:
            for end, found in machine.iter(ids):
                for item in found:
                    out.setdefault(item, end - n + 1)
    return out


def leaked(documents: DataFrame, items: DataFrame, n: int = N_WORDS) -> DataFrame:
    """(doc_id, item_id, word_no, start_at, end_at): the items with ``n`` words in a row in a document, and where the first such run stands.

    ``word_no`` counts the words before it; ``start_at`` and ``end_at`` are character places in the text as it was
    given, markup and all (an end beyond an entity or a letter that was rewritten is the start of that plus one).
    Places are traced only in documents with an item.  Null texts have no words.
    The items are read by the driver, up to a checked number of them.
    """
    rows = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text").limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items")
    known = tuple(sorted((r[0], r[1]) for r in rows))
    names = ["doc_id", "item_id", "word_no", "start_at", "end_at"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def rows_of(doc: int, text: str) -> list[tuple[int, ...]]:
        found = found_in(text, known, n)
        if not found:
            return []
        at = wikitext.placed_words(text)
        return [(doc, item, k, at[k][1], at[k + n - 1][2]) for item, k in sorted(found.items())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [r for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True) for r in rows_of(d, t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in (zip(*got, strict=True) if got else [[]] * len(names))], schema=schema)

    return documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, ", ".join(f"{c} long" for c in names))
