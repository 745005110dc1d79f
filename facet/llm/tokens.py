"""Exact tokenisation through a cache of chunks.

Both public vocabularies split a text into pre-tokens before byte-pair merging, and no pre-token runs from a
non-space character into a following space. A text may therefore be cut wherever a non-space is followed by white space
and the pieces encoded apart: the ids joined are the ids of the whole. Natural text repeats its words, so most
chunks come out of a dictionary; the rest go to the tokenizers library in batches.
"""

from __future__ import annotations

import array
import os
import re
import struct
from collections.abc import Iterable
from itertools import chain, compress, islice, repeat

import numpy as np

from .common import one_thread

# White space as the vocabularies' patterns know it (Unicode White_Space).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Keeps white space with what follows, for vocabularies that encode it.
WITH_SPACE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Without white space, for vocabularies that drop it.
WITHOUT_SPACE = re.compile(f"[^{WHITE}]+")


pack = struct.Struct("<I").pack
#: Letters that no normaliser of the vocabularies changes but by lower-casing, and marks that stand in one pre-token.
_LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
SIMPLE = re.compile(f"([ \\n]?)([{_LETTERS}]+)([.,!?;:|#$%&*]*)").fullmatch


# The vocabularies' own patterns of pre-tokens, for texts of Latin-1 characters alone, where every library agrees on what is a letter or a number.
_L, _N, _S = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "\\t-\\r \\x85\\xa0"
_SUFFIX = "'(?:s|t|re|ve|m|ll|d)"
PIECES_WITHOUT_SPACE = re.compile(f"[{_L}]+|{_SUFFIX}|[{_N}]|[^{_S}{_L}{_N}]+")
PIECES_WITH_SPACE = re.compile(f"{_SUFFIX}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: printable Latin-1 stands for itself, and the
    rest follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


def older_half(cache: dict) -> dict:
    """What came first comes most often: a full cache keeps its older half."""
    return dict(islice(cache.items(), len(cache) // 2))


class CachedEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes.

    path: the vocabulary file, for the tokenizers library. drops_space: the vocabulary lower-cases and drops white space
    (word_bpe_49k); else it keeps both (byte_bpe_50k). A chunk that is a plain word with marks behind it goes straight
    to the library's merge model, word and marks apart; any other chunk goes through the library's whole encoder. At
    most cache_entries chunks and as many words are kept, the older half when they are full; chunks over 40 characters
    never are. More distinct chunks at once than that are held for as long as their batch.
    """

    def __init__(self, path: str, drops_space: bool, cache_entries: int = 150_000):
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.drops_space = drops_space
        self.chunks = (WITHOUT_SPACE if drops_space else WITH_SPACE).findall
        self.pieces = (PIECES_WITHOUT_SPACE if drops_space else PIECES_WITH_SPACE).findall
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most = cache_entries
        self.alphabet = byte_alphabet()

    def split(self, text: str) -> list[str]:
        """Parts of a text whose ids, joined, are the text's: pre-tokens, of which fewer are different, or else chunks. A special token's string, which the library takes for the token, stays in one chunk."""
        if latin(text) and not any(s in text for s in self.special):
            return self.pieces(text.lower() if self.drops_space else text)
        return self.chunks(text)

    def _fresh(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.alphabet))
        return pack(tokens[0].id) if len(tokens) == 1 else b"".join([pack(t.id) for t in tokens])

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        if (got := self.words.get(piece)) is None:
            got = self._fresh(piece)
            if len(self.words) >= self.most:
                self.words = older_half(self.words)
            self.words[piece] = got
        return got

    def _encode(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        add, piece, fresh, simple, drops = out.append, self._piece, self._fresh, SIMPLE, self.drops_space
        odd = []
        for c in chunks:
            if m := simple(c):
                space, word, marks = m.groups()
                if drops:
                    word = word.lower()
                elif space == " ":
                    word = " " + word
                if not marks and space != "\n":
                    add(fresh(word))  # a pre-token: the cache alone will keep it
                    continue
                ids = piece(word)
                if not drops and space == "\n":
                    ids = piece(space) + ids
                add(ids + piece(marks) if marks else ids)
            else:
                odd.append(c)
                add(None)
        if odd:
            rest = iter(self.tokenizer.encode_batch_fast(odd, add_special_tokens=False))
            out = [array.array("I", next(rest).ids).tobytes() if x is None else x for x in out]
        return out

    def plain(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks by the library, special tokens' strings taken for ordinary text."""
        if not chunks:
            return []
        self.tokenizer.encode_special_tokens = True
        try:
            return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        finally:
            self.tokenizer.encode_special_tokens = False

    def _learn(self, chunks: Iterable[str]) -> list[str]:
        """Puts what the cache lacks of some chunks into it; returns the long ones, to be dropped again."""
        cache = self.cache
        distinct = set(chunks)
        new = distinct.difference(cache)
        if len(new) + len(cache) > self.most:
            cache = self.cache = older_half(cache)
            new = distinct.difference(cache)
        new = list(new)
        for k in range(0, len(new), 8192):
            part = new[k : k + 8192]
            cache.update(zip(part, self._encode(part)))
        return [c for c in new if len(c) > 40]

    def encode_split(self, split: list[list[str]]) -> list[bytes]:
        """One bytes object for each list of chunks."""
        long = self._learn(chain.from_iterable(split))
        get = self.cache.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in split]
        for c in long:
            del self.cache[c]
        return out

    def counts(self, chunks: list[str]) -> list[int]:
        """How many ids each chunk has."""
        long = self._learn(chunks)
        out = [len(x) >> 2 for x in map(self.cache.__getitem__, chunks)]
        for c in long:
            del self.cache[c]
        return out

    def encode(self, texts: Iterable[str | None], batch_chars: int = 1_000_000) -> Iterable[bytes]:
        """Ids of each text in turn (null: empty), with a bounded number of characters split at once."""
        held: list[list[str]] = []
        size = 0
        for t in texts:
            held.append(self.split(t or ""))
            size += len(t or "")
            if size >= batch_chars:
                yield from self.encode_split(held)
                held, size = [], 0
        if held:
            yield from self.encode_split(held)


class ColumnEncoder:
    """Encodes whole Arrow columns, for a vocabulary that lower-cases and drops white space.

    ASCII letters are lower-cased and the texts cut at ASCII white space by Arrow, and the different chunks numbered; one mark behind a letter at a chunk's end, or three of a kind, are a pre-token of their own and are
    taken off. So Python sees each different word of a column once, and a word that is new to the worker alone goes to the library. Words are kept until they number over `most`, then the oldest of them. Texts that hold the
    string of a special token are encoded by the library's rules for it, one by one.
    """

    def __init__(self, path: str, most: int = 800_000):
        self.by_chunk = CachedEncoder(path, True, 100_000)
        self.most = most
        self.index: dict[str, int] = {}
        # word k has the ids pool[ends[k] : ends[k + 1]]
        self.pool, self.ends, self.size = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), 0
        self.bytes = "".join(self.by_chunk.alphabet[b] for b in range(256))

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        one = self.by_chunk
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        letters = list(compress(words, plain.tolist()))
        foreign = [k for k, w in enumerate(letters) if not w.isascii()]
        where = np.flatnonzero(plain)
        for k in foreign:
            if latin(letters[k]):
                letters[k] = letters[k].lower().encode().decode("latin-1").translate(self.bytes)
            else:
                plain[where[k]] = False
                letters[k] = None
        tokenize, of_letters, lengths = one.model.tokenize, [], []
        for w in letters:
            if w is not None:
                tokens = tokenize(w)
                lengths.append(len(tokens))
                of_letters += [t.id for t in tokens]
        other, odd, rest = list(compress(words, (~plain).tolist())), [], []
        for w in other:
            if latin(w):
                rest.append(b"".join([one._piece(p) for p in one.pieces(w.lower())]))
            else:
                rest.append(None)
                odd.append(w)
        found = iter(one.plain(odd))
        rest = [next(found) if x is None else x for x in rest]
        sizes = np.zeros(len(words), np.int64)
        sizes[plain] = lengths
        sizes[~plain] = np.fromiter(map(len, rest), np.int64, len(rest)) // 4
        ids = np.zeros(int(sizes.sum()), np.uint32)
        of_plain = np.repeat(plain, sizes)
        ids[of_plain] = of_letters
        ids[~of_plain] = np.frombuffer(b"".join(rest), np.uint32)
        return ids, sizes

    def _add(self, words: list[str]) -> np.ndarray:
        """Puts new words behind the others; their numbers."""
        ids, sizes = self._new(words)
        n, m, used = self.size, len(words), int(self.ends[self.size])
        ends = used + np.cumsum(sizes)
        while len(self.ends) <= n + m:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.pool) < ends[-1]:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.ends[n + 1 : n + m + 1] = ends
        self.pool[used : ends[-1]] = ids
        self.size = n + m
        return np.arange(n, n + m)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of different words. More words than may be kept are there for one call."""
        if self.size > self.most:
            self.size = self.most // 2
            self.index = dict(islice(self.index.items(), self.size))
        found = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            these = [words[k] for k in new.tolist()]
            found[new] = self._add(these)
            self.index.update(zip(these, found[new].tolist()))
        return found

    def encode(self, texts, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). texts: an Arrow array of strings; a null is an empty text. end_id comes behind each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        ending = np.array([] if end_id is None else [end_id], np.uint32)
        if not len(texts):
            return ending[:0], np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, os.path.commonprefix(self.by_chunk.special)).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(special).tolist():
            special[k] = any(s in texts[k].as_py() for s in self.by_chunk.special)
        apart = np.flatnonzero(special)
        if len(apart):
            alone = [np.frombuffer(x, np.uint32) for x in self.by_chunk.encode(texts.take(pa.array(apart)).to_pylist())]
            texts = pc.if_else(pa.array(special), "", texts)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        base, tail = _cut(coded.dictionary)
        base, tail = base.dictionary_encode(), tail.dictionary_encode()
        words = pa.chunked_array([base.dictionary, tail.dictionary]).dictionary_encode().combine_chunks()  # a mark may be a word, too
        number, of = self._numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist()), words.indices.to_numpy()
        number = number[of]
        pairs = np.stack([number[base.indices.to_numpy()], number[len(base.dictionary) :][tail.indices.to_numpy()]], axis=1)
        start, size = self.ends[pairs], self.ends[pairs + 1] - self.ends[pairs]
        ids, ends = _gathered(self.pool, start.ravel(), size.ravel())
        # ids of the different chunks, then of all chunks
        ids, size = np.concatenate([ids, ending]), size.sum(axis=1)
        start = np.concatenate([ends[1::2] - size, ends[-1:]]).astype(np.int32)
        size = np.concatenate([size, [1]]).astype(np.int32)
        bounds = lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        if end_id is not None:
            codes = np.insert(codes, bounds[1:], len(size) - 1)
            bounds = bounds + np.arange(len(bounds))
        ends = np.concatenate([[0], np.cumsum(size[codes], dtype=np.int64)])
        out = np.empty(int(ends[-1]), np.uint32)
        for k in range(0, len(codes), 100_000):  # so that the places stay in the processor's caches
            some = codes[k : k + 100_000]
            out[ends[k] : ends[k + len(some)]] = _gathered(ids, start[some], size[some])[0]
        bounds = ends[bounds]
        lengths = np.diff(bounds)
        if len(apart):
            alone = [np.concatenate([x, ending]) for x in alone]
            lengths[apart] = [len(x) for x in alone]
            pieces, at = [], 0
            for k, x in zip(apart.tolist(), alone):
                pieces += [out[at : bounds[k]], x]
                at = bounds[k + 1]
            out = np.concatenate([*pieces, out[at:]])
        return out, lengths


class SpacedColumnEncoder(ColumnEncoder):
    """Encodes whole Arrow columns, for a vocabulary that keeps case and white space.

    The texts are cut, in place, wherever ASCII white space follows something else; the different chunks are numbered and the marks behind them taken off as in ColumnEncoder. A chunk that holds the string of a special token goes to the library whole.
    """

    def __init__(self, path: str, most: int = 300_000):
        super().__init__(path, most)
        self.by_chunk = CachedEncoder(path, False, 50_000)
        self.special = [s for s in self.by_chunk.special if s]

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        one = self.by_chunk
        tokenize, pieces, space = one.model.tokenize, one.pieces, one.alphabet[32]
        ids, sizes, odd = [], np.zeros(len(words), np.int64), []
        for k, w in enumerate(words):
            letters = w[1:] if w[:1] == " " else w
            if letters.isalpha() and latin(letters):
                if not letters.isascii():
                    letters = letters.encode().decode("latin-1").translate(self.bytes)
                parts = [space + letters if w[0] == " " else letters]
            elif latin(w) and not any(s in w for s in self.special):
                parts = [p.encode().decode("latin-1").translate(self.bytes) for p in pieces(w)]
            else:
                odd.append(k)
                continue
            n = len(ids)
            for p in parts:
                ids += [t.id for t in tokenize(p)]
            sizes[k] = len(ids) - n
        if not odd:
            return np.array(ids, np.uint32), sizes
        found = [np.array(e.ids, np.uint32) for e in one.tokenizer.encode_batch_fast([words[k] for k in odd], add_special_tokens=False)]
        sizes[odd] = list(map(len, found))
        out = np.zeros(int(sizes.sum()), np.uint32)
        apart = np.zeros(len(words), bool)
        apart[odd] = True
        apart = np.repeat(apart, sizes)
        out[~apart] = ids
        out[apart] = np.concatenate(found)
        return out, sizes

    def encode(self, texts, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        ending = np.array([] if end_id is None else [end_id], np.uint32)
        if not len(texts):
            return ending[:0], np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "").cast(pa.binary())
        bounds, data = _bytes(texts)
        cuts, bounds = _chunks(data[bounds[0] : bounds[-1]], bounds - bounds[0])
        begin = int(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset])
        offsets = pa.py_buffer((cuts + begin).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, texts.buffers()[2]]).dictionary_encode()
        codes = coded.indices.to_numpy()
        base, tail = _cut(coded.dictionary)
        base, tail = base.dictionary_encode(), tail.dictionary_encode()
        words = pa.chunked_array([base.dictionary, tail.dictionary]).dictionary_encode().combine_chunks()
        number, of = self._numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist()), words.indices.to_numpy()
        number = number[of]
        pairs = np.stack([number[base.indices.to_numpy()], number[len(base.dictionary) :][tail.indices.to_numpy()]], axis=1)
        start, size = self.ends[pairs], self.ends[pairs + 1] - self.ends[pairs]
        ids, ends = _gathered(self.pool, start.ravel(), size.ravel())
        return _joined(ids, ends[1::2], size.sum(axis=1), codes, bounds, ending)


def _joined(ids: np.ndarray, ends: np.ndarray, size: np.ndarray, codes: np.ndarray, bounds: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each) from the ids of the different chunks, where each of these ends and its size, the chunks' codes and the texts' bounds among them; ending (one id or none) comes behind each text."""
    ids, start = np.concatenate([ids, ending]), np.concatenate([ends - size, [len(ids)]]).astype(np.int32)
    size = np.concatenate([size, [1]]).astype(np.int32)
    if len(ending):
        codes = np.insert(codes, bounds[1:], len(size) - 1)
        bounds = bounds + np.arange(len(bounds))
    ends = np.concatenate([[0], np.cumsum(size[codes], dtype=np.int64)])
    out = np.empty(int(ends[-1]), np.uint32)
    for k in range(0, len(codes), 100_000):  # so that the places stay in the processor's caches
        some = codes[k : k + 100_000]
        out[ends[k] : ends[k + len(some)]] = _gathered(ids, start[some], size[some])[0]
    return out, np.diff(ends[bounds])


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and bytes of a binary column."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return bounds, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)


def _chunks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the chunks of texts that lie side by side in data, UTF-8, and which of them bound the texts. Chunks begin with their text, and where ASCII white space follows something other than white space. An empty text has no chunk."""
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    space = white[data]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    # white space beyond ASCII may end in the byte before
    high = np.flatnonzero(data[at - 1] >= 0x80)
    if len(high):
        p = at[high]
        b1, b2, b3 = (np.where(p >= k, data[np.maximum(p - k, 0)], 0) for k in (1, 2, 3))
        of_two = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        of_three = (b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80) | (b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F) | (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80)
        of_three |= (b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))
        at = np.delete(at, high[of_two | of_three])
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    cut[bounds] = True
    cuts = np.flatnonzero(cut)
    return cuts, np.searchsorted(cuts, bounds)


def _cut(chunks):
    """Chunks without the marks behind their last letter, where these are one or three of a kind, and those marks."""
    import pyarrow as pa
    import pyarrow.compute as pc

    whole = chunks.cast(pa.binary())
    bounds, data = _bytes(whole)
    end, size = bounds[1:], np.diff(bounds)
    byte = lambda k: np.where(size >= k, data[np.maximum(end - k, 0)], 32)
    b1, b2, b3, b4, b5 = map(byte, range(1, 6))
    mark = (b1 > 32) & (b1 < 127) & ~((b1 >= 48) & (b1 < 58)) & ~((b1 >= 65) & (b1 < 91)) & ~((b1 >= 97) & (b1 < 123))
    # a small ASCII letter, or the two bytes of a Latin-1 letter from U+00C0 on
    letter = lambda x, y: ((x >= 97) & (x < 123)) | ((y == 0xC3) & (x >= 0x80) & (x != 0x97) & (x != 0xB7))
    three = mark & (b1 == b2) & (b1 == b3) & letter(b4, b5)
    one = mark & letter(b2, b3)
    one, three = pa.array(one), pa.array(three)
    base = pc.if_else(one, pc.binary_slice(whole, 0, -1), pc.if_else(three, pc.binary_slice(whole, 0, -3), whole))
    tail = pc.if_else(one, pc.binary_slice(whole, -1), pc.if_else(three, pc.binary_slice(whole, -3), pa.scalar(b"", pa.binary())))
    return base.cast(pa.string()), tail.cast(pa.string())


def _gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joined slices of pool and where each ends."""
    ends = np.cumsum(size, dtype=size.dtype)
    at = np.repeat(start - (ends - size), size)
    at += np.arange(len(at), dtype=at.dtype)
    return pool.take(at, mode="clip"), ends


_encoders: dict[tuple, CachedEncoder | ColumnEncoder] = {}


def encoder(path: str, drops_space: bool) -> CachedEncoder:
    """One encoder for each vocabulary and Python worker, so that tasks after the first find its cache filled."""
    if (path, drops_space) not in _encoders:
        _encoders[path, drops_space] = CachedEncoder(path, drops_space)
    return _encoders[path, drops_space]


def column_encoder(path: str, drops_space: bool = True) -> ColumnEncoder:
    if (path, drops_space, "column") not in _encoders:
        _encoders[path, drops_space, "column"] = ColumnEncoder(path) if drops_space else SpacedColumnEncoder(path)
    return _encoders[path, drops_space, "column"]
