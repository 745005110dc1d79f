"""Token counts that survive edits.

A document's pre-tokens (runs that no merge of the vocabulary crosses) are the leaves of a segment tree; a leaf has its numbers of characters and ids, an inner node the sums below it. After an edit only the
leaves that it touches, and as many at either side as the cutting of pre-tokens can see, are cut and encoded anew; the sums are updated on the paths above them. Everything else keeps its counts, and its text:
leaves lie in blocks that hold their own part of the text, so that an edit copies a block's characters and not the document's.

How far an edit reaches: the text is cut wherever a non-space is followed by white space, and such a cut depends on these two characters alone. Cuts inside the edited range may come and go; the cut before it and
the first cut behind it stay. So the chunks that the edit touches, with one more at each side, hold all that changes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_thread
from .tokens import CachedEncoder, encoder


class SumTree:
    """A sequence of (characters, ids) leaves with sums, and the text they cut: leaves lie in blocks of at most 2 * width, each with its part of the text, and the
    blocks' sums in an array tree above them. A position is found and leaves are replaced in about width + log(blocks) steps for each block they lie in. A block may be empty; the tree is built anew only
    when a block has outgrown its bound, which takes about width new leaves."""

    def __init__(self, leaves: np.ndarray, text: str, width: int = 128):
        self.width = width
        self.blocks, self.parts = self._cut(leaves, text)
        self._rebuild()

    def _cut(self, leaves: np.ndarray, text: str) -> tuple[list[np.ndarray], list[str]]:
        blocks, parts, at = [], [], 0
        for k in range(0, len(leaves), self.width):
            blocks.append(leaves[k : k + self.width])
            end = at + int(blocks[-1][:, 0].sum())
            parts.append(text[at:end])
            at = end
        return (blocks, parts) if blocks else ([leaves], [text])

    def _rebuild(self) -> None:
        full = [k for k, b in enumerate(self.blocks) if len(b)] or [0]
        self.blocks, self.parts = [self.blocks[k] for k in full], [self.parts[k] for k in full]
        n = 1
        while n < len(self.blocks):
            n *= 2
        self.n = n
        self.sums = np.zeros((2 * n, 2), np.int64)
        for k, b in enumerate(self.blocks):
            self.sums[n + k] = b.sum(axis=0)
        level = n
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    @property
    def characters(self) -> int:
        return int(self.sums[1][0])

    @property
    def ids(self) -> int:
        return int(self.sums[1][1])

    def find(self, character: int) -> tuple[int, int, int]:
        """(block, leaf in it, first character of the leaf) of the leaf that holds a character of the text."""
        node, left = 1, 0
        while node < self.n:
            node *= 2
            if left + self.sums[node][0] <= character and self.sums[node + 1][0] > 0:
                left += int(self.sums[node][0])
                node += 1
        k = node - self.n
        ends = left + np.cumsum(self.blocks[k][:, 0])
        j = min(int(np.searchsorted(ends, character, side="right")), max(0, len(ends) - 1))
        return k, j, int(ends[j] - self.blocks[k][j, 0]) if len(ends) else left

    def text(self, first: tuple[int, int], last: tuple[int, int]) -> str:
        """The text of the leaves from first to last (block, leaf), both included."""
        (a, i), (b, j) = first, last
        begin, end = int(self.blocks[a][:i, 0].sum()), int(self.blocks[b][: j + 1, 0].sum())
        return self.parts[a][begin:end] if a == b else "".join([self.parts[a][begin:], *self.parts[a + 1 : b], self.parts[b][:end]])

    def replace(self, first: tuple[int, int], last: tuple[int, int], leaves: np.ndarray, text: str) -> None:
        """Puts leaves and their text in place of those from first to last, both included."""
        (a, i), (b, j) = first, last
        begin, end = int(self.blocks[a][:i, 0].sum()), int(self.blocks[b][: j + 1, 0].sum())
        behind, rest = self.blocks[b][j + 1 :], self.parts[b][end:]
        head, start = self.blocks[a][:i], self.parts[a][:begin]
        if a == b:
            new, part = np.concatenate([head, leaves, behind]), start + text + rest
        else:
            new, part = np.concatenate([head, leaves]), start + text
            for k in range(a + 1, b):
                self.blocks[k], self.parts[k] = behind[:0], ""
            self.blocks[b], self.parts[b] = behind, rest
        self.blocks[a], self.parts[a] = new, part
        if len(new) > 2 * self.width:
            self.blocks[a : a + 1], self.parts[a : a + 1] = self._cut(new, part)
            self._rebuild()
            return
        for k in range(a, b + 1):
            self.sums[self.n + k] = self.blocks[k].sum(axis=0)
        low, high = (self.n + a) // 2, (self.n + b) // 2
        while low:
            self.sums[low : high + 1] = self.sums[2 * low : 2 * high + 2].reshape(-1, 2, 2).sum(axis=1)
            low, high = low // 2, high // 2


class CountedText:
    """A text with its counts. edit() is exact: count equals the number of ids of the whole new text."""

    def __init__(self, text: str, enc: CachedEncoder):
        self.enc = enc
        self.encoded = 0
        self.tree = SumTree(self._leaves(text), text)

    def _leaves(self, text: str) -> np.ndarray:
        chunks = self.enc.chunks(text)
        self.encoded += len(text)
        return np.stack([np.fromiter(map(len, chunks), np.int64, len(chunks)), np.fromiter(self.enc.counts(chunks), np.int64, len(chunks))], axis=1)

    @property
    def text(self) -> str:
        return "".join(self.tree.parts)

    @property
    def count(self) -> int:
        return self.tree.ids

    def crc32(self) -> int:
        """Of the text as UTF-8."""
        crc = 0
        for part in self.tree.parts:
            crc = zlib.crc32(part.encode("utf-8", "surrogatepass"), crc)
        return crc

    def edit(self, start: int, end: int, put: str) -> None:
        """Replaces the characters from start to end (exclusive) by put."""
        tree, size = self.tree, self.tree.characters
        if not 0 <= start <= end <= size:
            raise ValueError("an edit lies within the text")
        if not size:
            self.tree = SumTree(self._leaves(put), put)
            return
        a, i, left = tree.find(max(0, start - 1))
        if left:  # one leaf more before
            a, i, left = tree.find(left - 1)
        b, j, right = tree.find(min(end, size - 1))
        stop = right + int(tree.blocks[b][j, 0])
        if stop < size:  # and one behind
            b, j, right = tree.find(stop)
        was = tree.text((a, i), (b, j))
        region = was[: start - left] + put + was[end - left :]
        tree.replace((a, i), (b, j), self._leaves(region), region)


COUNTS = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, chars_encoded_again long, crc32_after long"
NAMES = ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "chars_encoded_again", "crc32_after"]


def counted(docs: DataFrame, tokenizer_path: str, edits_of: Callable[[str], list[dict]] | None = None) -> DataFrame:
    """Counts before and after the edits of each document, and how many characters were encoded again.

    An edit has start, end and put, in code points of the original text; a document's edits lie apart from one another and in ascending order. They come from edits_of(text), or from the
    column `edits`, an array of such structs or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        enc = encoder(tokenizer_path, False)
        for batch in batches:
            rows = []
            texts = batch.column(1).to_pylist()
            for text, edits in zip(texts, map(edits_of, (t or "" for t in texts)) if edits_of else batch.column(2).to_pylist()):
                t = CountedText(text or "", enc)
                before, first = t.count, t.encoded
                edits = edits or []
                for e in reversed(edits):  # from the end, so that earlier places keep their numbers
                    t.edit(e["start"], e["end"], e["put"] or "")
                rows.append((before, len(edits), t.count, t.encoded - first, t.crc32()))
            made = np.array(rows, dtype=np.int64).reshape(-1, 5)
            # names stay in Arrow: through pandas a null would make floating point of the others
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(made[:, j])) for j in range(5))], names=NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text", *([] if edits_of else ["edits"])).mapInArrow(run, COUNTS)


_NUMBER = re.compile("[0-9]{4,}")


def number_edits(text: str, put: str = "<num>") -> list[dict]:
    """Edits that put `put` in place of every run of four digits or more."""
    return [{"start": m.start(), "end": m.end(), "put": put} for m in _NUMBER.finditer(text)]


def op1_token_counts(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document (doc_id, text): tokens of the whole text, and after the edits of number_edits(), by edit-aware counting.

    Nulls: a null text is an empty one (0 tokens); a null doc_id stays null, and others keep all their digits beside it. Repeated rows give repeated rows. Empty table: no rows. Further columns are ignored. The string of a
    special token counts as that token, as the library has it.
    """
    return counted(docs, tokenizer_path, number_edits)
