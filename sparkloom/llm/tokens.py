"""Token counts with overlap resynchronisation, and token ids for packing."""

from __future__ import annotations

import json
import os
import re
import struct
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import only, prepare, text_or_empty

#: Characters up to which a text is encoded at once; longer ones go in overlapping chunks.
CHUNK = 32_768
#: Characters by which neighbouring chunks overlap at first; doubled as long as they don't align.
OVERLAP = 256
#: Distinct words whose ids a Python worker remembers.
REMEMBERED = 150_000


def tokenizer(path: str):
    """The tokenizers library's object for a file, one for each worker process; its threads are off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    kept = sys.__dict__.setdefault("_sparkloom_tokenizers", {})
    if path not in kept:
        kept[path] = Tokenizer.from_file(path)
        kept[path].no_truncation()
        kept[path].no_padding()
    return kept[path]


def beginnings(encoding) -> dict[int, int]:
    """The tokens before each character at which a pre-token (or a special token) begins."""
    out, last = {}, object()
    for k, (word, span) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word is None or word != last:
            out[span[0]] = k
        last = word
    return out


def count_long(text: str, t, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length, from encodings of overlapping chunks spliced at common beginnings of pre-tokens.

    This holds for a pre-tokenizer that matches from left to right, looks at
    nothing before a match and at one character at most behind it (the byte-level
    pattern), and special strings that are found from left to right and can't
    overlap themselves. A beginning in the left chunk is proven if the chunk's own
    first character is one and no special string that the chunk's end cuts off can
    reach it. If the right chunk has a beginning at the same character, both go on
    alike from there, so the left one's tokens up to it and the right one's from it
    on are those of the whole. Without a common one the overlap is doubled, and
    once it covers the left chunk, that chunk.
    """
    margin = max([1, *(len(x.content) for x in t.get_added_tokens_decoder().values())])
    encode = lambda a, b: t.encode(text[a:b], add_special_tokens=False)
    total, base, size, n = 0, 0, chunk, len(text)
    left, skip, origin, end = encode(0, min(size, n)), 0, 0, min(size, n)  # left: encoding of [origin, end), proven from base, its token `skip`, on
    while end < n:
        known = {origin + c: k for c, k in beginnings(left).items() if origin + c > base and origin + c <= end - margin}
        wide, found = overlap, None
        while found is None and end - wide > base:
            begin = end - wide
            right = encode(begin, min(n, begin + max(size, 2 * wide)))
            found = next(((begin + c, k) for c, k in beginnings(right).items() if begin + c in known), None)
            wide *= 2
        if found is None:  # one pre-token, or hardly more: a longer chunk from the last proven beginning
            size *= 2
            left, skip, origin, end = encode(base, min(n, base + size)), 0, base, min(n, base + size)
            continue
        total += known[found[0]] - skip
        base, skip = found
        left, origin, end, size = right, begin, min(n, begin + max(size, wide)), chunk
    return total + len(left.ids) - skip


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row of docs, whole texts.

    No begin, end or other special tokens are added; special strings in a text are
    what the library makes of them by default. A null or empty text has 0 bytes and
    tokens. Rows are counted one by one: repeated rows and null doc_ids come back
    as they are, other columns are left out, no rows give none.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            counts = np.zeros(len(texts), np.int64)
            short = [i for i, x in enumerate(texts) if len(x) <= chunk]
            for i in range(0, len(short), 64):  # encodings take many times the texts' memory
                part = short[i : i + 64]
                counts[part] = [len(e.ids) for e in t.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)]
            for i, x in enumerate(texts):
                if len(x) > chunk:
                    counts[i] = count_long(x, t, chunk, overlap)
            sizes = pa.array([len(x.encode()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = only(docs, ["doc_id", "text"]).select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


class WordIds(dict):
    """Ids, as little-endian bytes, of words between white space, for a word-end BPE file that drops white space.

    Its pre-tokens hold and look at no white space, so the ids of a text are those
    of its words in turn. Words of Latin letters, digits and signs are merged by
    the byte-pair coder of tiktoken with the file's own vocabulary, a byte that UTF-8
    never has standing for the word's end; this is several times as fast. It merges
    any neighbours whose bytes together are a token, in the order of token ids. As
    every token of the file is what the file's own merges make of its bytes, only
    the listed pair of a token can ever stand side by side within its bytes, so both
    merge alike. All other words go to the tokenizers library.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        super().__init__()
        self.path, self.most = path, most
        self.merge, self.pieces = _fast(path), regex.compile(PIECES)

    def __missing__(self, word: str) -> bytes:
        if self.merge and PLAIN.fullmatch(word) and "<|" not in word:
            low = word.lower()
            if low.isalpha():
                ids = self.merge(low.encode() + b"\xff")
            elif low[:-1].isalpha() and low[-1] in ".,!?;:":
                ids = self.merge(low[:-1].encode() + b"\xff") + self.merge(low[-1:].encode() + b"\xff")
            else:
                ids = [i for piece in self.pieces.findall(low) for i in self.merge(piece.encode() + b"\xff")]
        else:
            ids = tokenizer(self.path).encode(word, add_special_tokens=False).ids  # loaded once it is needed
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.most:
            self[word] = out
        return out

    def of(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


# The file's pre-token pattern, and the characters that are lower-cased and classed alike everywhere and are in composed form.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u024f]*")


def _fast(path: str) -> Callable[[bytes], list[int]] | None:
    """tiktoken's coder for the file, if it is a BPE file with word ends and that pattern."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    if told["model"].get("end_of_word_suffix") != "</w>" or json.dumps(PIECES) not in json.dumps(told["pre_tokenizer"]):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {t["content"] for t in told["added_tokens"]}
    ranks = {}
    for token, i in told["model"]["vocab"].items():
        if token not in special:
            body = token.removesuffix("</w>")
            ranks[bytes(byte[c] for c in body) + b"\xff" * (body != token)] = i
    return tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


def word_ids(path: str) -> WordIds:
    """One for each worker process and file."""
    kept = sys.__dict__.setdefault("_sparkloom_word_ids", {})
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]
