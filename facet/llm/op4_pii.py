"""Personal data: fixed patterns, and a character-level BiLSTM-CRF that adds what they cannot express.

Base spans are the leftmost non-overlapping matches of four patterns, checked (parts of an address at most 255, Luhn, numbers of digits); a match that fails
its check is dropped and not tried again. That loses, for instance, two card numbers side by side, or a phone number with digits behind it, and no pattern knows a phone number without "+", an IPv6 address or a secret (a key or token in quotes behind a name).
The network reads such places character by character, and its spans are added where they touch no base span and pass a check of their kind that is wider than the pattern: see plausible().

The network is trained in numpy, from labelled spans in made-up text of a seeded generator. Each kind holds a digit or an "@", so that it reads the neighbourhood of those characters and nothing else. A neighbourhood is cut into
overlapping windows; each is decoded by itself, every character takes its tag from the window in which it lies furthest from an edge, and spans are read off the joined tags, so that a span may be longer than a window. Of overlapping spans of one document the surer one stays.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_thread, release_unused
from .tagger import Tagger

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4  # kinds that have a pattern
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ANY = re.compile("[0-9@]")
_NOT_DIGIT = re.compile("[^0-9]+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def valid(kind: int, s: str) -> bool:
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))
    digits = _NOT_DIGIT.sub("", s)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of EMAIL, found from each "@" outwards, so that long runs without one cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield a, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str | None) -> list[Span]:
    """By kind as listed, then by start."""
    if not text or not ANY.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        if kind == 3 and "+" not in text:
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return out


# Classes of characters: one for digits, for hexadecimal and other letters of either case, each mark below by itself, other ASCII, other letters, the rest.
MARKS = "@.+-()_%: \n,;=\"'/#|"
FIRST_MARK = 8
N_CLASSES = FIRST_MARK + len(MARKS)
_ASCII = np.full(128, 5, np.int16)
for _k, _range in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")):
    for _c in _range:
        _ASCII[ord(_c)] = _k
for _k, _c in enumerate(MARKS):
    _ASCII[ord(_c)] = FIRST_MARK + _k
N_TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
WINDOW, STRIDE, REACH = 96, 48, 32


def classes_of(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c < 128, _ASCII[np.minimum(c, 127)], 6 + (c > 0x24F)).astype(np.int16)


def made_up(r: np.random.Generator, least: int) -> tuple[str, np.ndarray]:
    """At least so many characters of text and their tags."""
    parts, tags = [], []
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, r.integers(1, 10)))

    def put(s: str, kind: int = -1) -> None:
        parts.append(s)
        t = np.zeros(len(s), np.int64)
        if kind >= 0:
            t[:] = 2 + 2 * kind
            t[0] = 1 + 2 * kind
        tags.append(t)

    def one(kind: int) -> None:
        if kind == 0:
            put(word() + (r.choice([".", "_", "-", ""]) + digits(r.integers(1, 4)) if r.random() < 0.6 else "") + "@" + word() + r.choice([".com", ".example.com", ".co.uk", ".org"]), 0)
        elif kind == 1:
            six = ":".join("".join("0123456789abcdef"[k] for k in r.integers(0, 16, 4)) for _ in range(8))
            put(six if r.random() < 0.25 else ".".join(str(x) for x in r.integers(0, 256, 4)), 1)
        elif kind == 2:
            n, sep = int(r.choice([13, 14, 15, 16, 16, 16, 16, 19])), r.choice(["", "", " ", "-"])
            d = digits(n)
            put(sep.join(d[k : k + 4] for k in range(0, n, 4)), 2)
        elif kind == 3:
            a, b, c = digits(3), digits(3), digits(4)
            if r.random() < 0.25:
                put(r.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}"]), 3)
            else:
                put("+" + digits(r.integers(1, 3)) + r.choice([f" ({a}) {b}-{c}", f" {a} {b} {c}", f"-{a}-{b}-{c}", f"{a}{b}{c}", f" {a}.{b}.{c}"]), 3)
        else:
            letters = r.choice(["0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
            value = "".join(letters[k] for k in r.integers(0, len(letters), int(r.choice([20, 32, 40, 40, 64]))))
            quote = r.choice(['"', '"', "'"])
            name = r.choice([word(), word().upper(), word() + "_" + word()])
            put(name + r.choice([" = ", "=", ": ", ":"]) + quote)
            put(value, 4)
            put(quote)

    while sum(map(len, parts)) < least:
        x = r.random()
        if x < 0.5:
            put(" ".join(w.capitalize() if r.random() < 0.2 else w.upper() if r.random() < 0.1 else w for w in (word() for _ in range(r.integers(1, 6)))) + r.choice(["", ".", ",", "!!", "###", "%%%", ":"]))
        elif x < 0.86:
            one(kind := int(r.integers(0, len(KINDS))))
            if r.random() < 0.3 and kind < 4:  # side by side
                put(" ")
                one(kind)
            if r.random() < 0.15 and kind < 4:
                put(r.choice([" ", " - ", " ("]) + digits(r.integers(1, 5)))
        else:
            h = "".join("0123456789abcdef"[k] for k in r.integers(0, 16, 40))
            put(str(r.choice([f"{word()} {h}", f"{word()} {h[:7]}", f'{word()} = "{word()}"', f'{word()} = "{digits(3)}"', digits(4), f"{digits(2)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", digits(6), f"{digits(2)}:{digits(2)}", f"@{word()}", "C++"])))
        put(str(r.choice([" ", " ", " ", " | ", "\n", "!! ", "### "])))
    return "".join(parts), np.concatenate(tags)


_trained: dict[tuple, Tagger] = {}


def trained(steps: int = 400, batch: int = 64, length: int = 48, seed: int = 11) -> Tagger:
    """The network, trained once in a process for given parameters; the same each time."""
    key = (steps, batch, length, seed)
    if key not in _trained:
        r = np.random.default_rng(seed)
        text, tags = made_up(r, steps * 800)
        x = classes_of(text)

        def batches():
            for _ in range(steps):
                a = r.integers(0, len(x) - length, batch)[:, None] + np.arange(length)
                yield x[a], tags[a]

        model = Tagger(N_CLASSES, N_TAGS)
        # transitions start from what tags mean: inside follows begin or inside of its kind
        for kind in range(len(KINDS)):
            model.p["tr"][:, 2 + 2 * kind] = -4
            model.p["tr"][[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = 2
            model.p["st"][2 + 2 * kind] = -1
        model.train(batches())
        _trained[key] = model
    return _trained[key]


def regions(text: str) -> list[tuple[int, int]]:
    """Neighbourhoods of digits and "@", apart from one another."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.flatnonzero(((c >= 48) & (c <= 57)) | (c == 64))
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * REACH)
    starts, ends = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]
    return [(max(0, int(a) - REACH), min(len(c), int(b) + 1 + REACH)) for a, b in zip(starts, ends)]


def network_spans(texts: list[str], model: Tagger, at_once: int = 2048) -> list[list[tuple[float, Span]]]:
    """Per text the decoded spans with how sure they are, before any check."""
    x, where = [], []
    for k, text in enumerate(texts):
        if not text or not ANY.search(text):
            continue
        c = None
        for a, b in regions(text):
            if c is None:
                c = classes_of(text)
            start = a
            while True:
                end = min(b, start + WINDOW)
                w = np.full(WINDOW, FIRST_MARK + MARKS.index(" "), np.int16)
                w[: end - start] = c[start:end]
                x.append(w)
                where.append((k, start, end, a, b))
                if end == b:
                    break
                start += STRIDE
    out: list[list[tuple[float, Span]]] = [[] for _ in texts]
    held: list[tuple[int, np.ndarray, np.ndarray]] = []  # the open neighbourhood's windows: start, tags, how sure
    for j in range(0, len(x), at_once):
        em = model.emissions(np.stack(x[j : j + at_once]))
        tags = model.viterbi(em)
        sure = np.take_along_axis(em, tags.T[:, :, None].astype(np.int64), axis=2)[:, :, 0].T - em[:, :, 0].T
        some = (tags > 0).any(axis=1)
        for i in range(len(tags)):
            k, start, end, a, b = where[j + i]
            if start == a:
                held = []
            held.append((start, tags[i, : end - start], sure[i, : end - start], some[i]))
            if end == b and any(h[3] for h in held):
                out[k] += spans_of(*joined([h[:3] for h in held]), a)
    return out


def joined(windows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Tags and how sure they are, of a neighbourhood from its overlapping windows (start, tags, sure) in order: of two windows' overlap the first half comes from the first."""
    tags, sure = [], []
    at = windows[0][0]
    for k, (start, t, s) in enumerate(windows):
        end = start + len(t)
        to = end if k + 1 == len(windows) else (windows[k + 1][0] + end) // 2
        tags.append(t[at - start : to - start])
        sure.append(s[at - start : to - start])
        at = to
    return np.concatenate(tags), np.concatenate(sure)


def spans_of(tags: np.ndarray, sure: np.ndarray, offset: int) -> list[tuple[float, Span]]:
    """The spans of joined tags. An inside tag that follows nothing of its kind, as it may where two windows meet, begins a span."""
    kind = (tags.astype(np.int64) - 1) // 2  # -1 for O
    new = (tags > 0) & ((tags % 2 == 1) | (kind != np.r_[-1, kind[:-1]]))
    out = []
    for p in np.flatnonzero(new).tolist():
        q = p + 1
        while q < len(tags) and tags[q] == 2 + 2 * kind[p]:
            q += 1
        out.append((float(sure[p:q].mean()), (int(kind[p]), offset + p, offset + q)))
    return out


FULL = (EMAIL, IP, CARD, PHONE)
_GROUPED = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
_LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}")
_SECRET = re.compile(r"[A-Za-z0-9_+/=.-]{16,}")


def plausible(kind: int, s: str) -> bool:
    """Whether a span that the network found can be what it says."""
    if kind < BASE and FULL[kind].fullmatch(s):
        return valid(kind, s)
    if kind == 1 and s.count(":") >= 2:
        try:
            return ipaddress.IPv6Address(s) is not None
        except ValueError:
            return False
    if kind == 3:
        return bool(_LOCAL_PHONE.fullmatch(s))
    return kind == 4 and bool(_SECRET.fullmatch(s)) and any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def cards_within(s: str) -> list[tuple[int, int]]:
    """Card numbers side by side in a run of digits that is too long for one: from the left, the first groups of digits that make a valid number, 16 digits before other lengths."""
    out, done = [], 0
    groups = [m.span() for m in re.finditer("[0-9]+", s)]
    if sum(b - a for a, b in groups) <= 19:
        return []  # one number, and not a valid one: a part of it is none either
    if len(groups) == 1:  # no separators: the whole run must be such numbers
        while done < len(s):
            n = next((n for n in (16, 15, 14, 13, 19, 18, 17) if len(s) - done >= n and luhn(s[done : done + n])), 0)
            if not n:
                return []
            out.append((done, done + n))
            done += n
        return out
    for i, (a, _) in enumerate(groups):
        if a < done:
            continue
        ends = [(abs(len(_NOT_DIGIT.sub("", s[a:b])) - 16), b) for _, b in groups[i:]]
        for _, b in sorted(ends):
            if _GROUPED.fullmatch(s[a:b]) and valid(2, s[a:b]):
                out.append((a, b))
                done = b
                break
    return out


def all_spans(texts: list[str | None], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind, then start."""
    texts = [t or "" for t in texts]
    out = []
    for text, found in zip(texts, network_spans(texts, model)):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        added: list[Span] = []
        seen = []
        for sure, (kind, a, b) in found:
            s = text[a:b]
            if kind == 2 and not plausible(kind, s):
                # the whole run of digits, of which the network may have cut a part
                run = next((m for m in CARD.finditer(text, max(0, a - 40), b + 40) if m.start() < b and m.end() > a), None)
                seen += [(sure, (2, run.start() + x, run.start() + y)) for x, y in cards_within(run.group())] if run else []
            elif plausible(kind, s):
                seen.append((sure, (kind, a, b)))
        for _sure, (kind, a, b) in sorted(set(seen), key=lambda f: (-f[0], f[1])):
            if all(b <= x or a >= y for x, y in taken):
                added.append((kind, a, b))
                taken.append((a, b))
        out.append((base, sorted(base + added)))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long"
NAMES = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_secret"]
#: Texts are read in slices of about so many bytes, so that the windows of a slice fit a task's memory.
SLICE_BYTES = 4_000_000


def op4_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): numbers of base spans by kind, their digest, all spans as kind:start:end in code points, how many the network added, and how many of those are secrets.

    Nulls: a null text is an empty one; a null doc_id stays null, and others keep all their digits beside it. Spans of different kinds may overlap in the base (each kind is matched by itself); added spans overlap none, and may have any length. Repeated rows
    give repeated rows. Empty table: no rows. Further columns are ignored.
    """
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.column(1).nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                columns: list[list] = [[] for _ in NAMES[1:]]
                for base, spans in all_spans(part.column(1).to_pylist(), model):
                    n = [sum(k == j for k, _, _ in base) for j in range(BASE)]
                    row = (*n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base), sum(k == BASE for k, _, _ in spans))
                    for c, v in zip(columns, row):
                        c.append(v)
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with <KIND> for every span; overlapping spans become one, under the first's name."""
    if not spans:
        return text
    parts, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            parts.append(text[done:a])
            parts.append(f"<{KINDS[kind].upper()}>")
        done = max(done, b)
    return "".join([*parts, text[done:]])


def masked_column(model: Tagger):
    """A column function: texts with every span of all_spans() masked."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one_thread()
        for texts in batches:
            out: list[str | None] = []
            for t in slices(texts.tolist()):
                out += [masked(x, spans) for x, (_, spans) in zip(t, all_spans(t, model))]
            yield pd.Series(out, dtype=object)
        release_unused()

    return F.pandas_udf(run, "string")


def slices(texts: list[str | None], chars: int = SLICE_BYTES) -> Iterator[list[str | None]]:
    """The texts in order, in lists of at most so many characters or one text."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > chars:
            yield texts[start:k]
            start, size = k, 0
        size += len(t or "")
    if start < len(texts):
        yield texts[start:]
