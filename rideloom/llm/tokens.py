"""Encoding with public byte-level BPE tokenizers.

The vocabulary is a local file of ranks whose path is a parameter; every Python worker loads it once. Long texts
are cut before a white-space character that follows a non-white one: no pre-token of the pattern crosses such a
place and none looks back over it, so the ids of the pieces in order are those of the whole text. Pieces are
encoded as ordinary text; strings that look like special tokens are text.

Defined results: null and empty texts have the empty list; texts that aren't valid Unicode (unpaired surrogates)
are encoded with the replacement character; ids are exact for texts of any length; other columns are kept out.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files, unless given.
TOKENIZERS = os.environ.get("RIDELOOM_TOKENIZERS", "/opt/tokenizers")
#: Texts longer than this many characters are cut into pieces of about this size.
PIECE = 100_000
#: Fixed value: the public pre-tokenizer pattern of these byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file: a line holds a token in base64 and its rank."""
    import tiktoken

    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Before plain white space that follows a character that is white space by no definition.
_SAFE = regex.compile(r"(?<=\S)(?=[ \t\r\n])")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text cut at safe places, each piece ending at the first one from size characters on."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, path: str, size: int = PIECE) -> list[int]:
    if not text:
        return []
    enc = encoding(path)
    if len(text) <= size:
        return _ordinary(enc, text)
    return [i for p in pieces(text, size) for i in _ordinary(enc, p)]


def _ordinary(enc, text: str) -> list[int]:
    try:
        return enc.encode_ordinary(text)
    except UnicodeEncodeError:
        return enc.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def decode(ids: list[int], path: str) -> bytes:
    """The raw bytes of the ids; decoding bytes, not text, is what makes the round trip exact."""
    return encoding(path).decode_bytes(ids)


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


def token_ids(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep: tuple[str, ...] = (), size: int = PIECE) -> DataFrame:
    """(id, keep..., ids): the ids of each row's text, in order."""
    path = path or vocabulary()
    d = documents.select(id_col, *keep, text_col)
    n = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, offsets = [], np.zeros(b.num_rows + 1, np.int32)
            for i, t in enumerate(b.column(n).to_pylist()):
                ids = encode(t, path, size)
                out.append(np.asarray(ids, np.int32))
                offsets[i + 1] = offsets[i] + len(ids)
            values = np.concatenate(out) if out else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], ids], names=[id_col, *keep, "ids"])

    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    return d.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in (id_col, *keep)] + ["ids array<int>"]))


def token_counts(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep: tuple[str, ...] = (), size: int = PIECE) -> DataFrame:
    """(id, keep..., tokens): the number of ids of each row's text, without sending the ids back."""
    path = path or vocabulary()
    d = documents.select(id_col, *keep, text_col)
    n = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = pa.array([len(encode(t, path, size)) for t in b.column(n).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], counts], names=[id_col, *keep, "tokens"])

    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    return d.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in (id_col, *keep)] + ["tokens long"]))


def decoded(encoded: DataFrame, *, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, text): texts again from their ids."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if ids is None else decode(ids, path).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    e = encoded.select(id_col, F.col("ids"))
    return e.mapInArrow(run, f"`{id_col}` {e.schema[id_col].dataType.simpleString()}, text string")
