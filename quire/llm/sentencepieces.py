"""Encoding and decoding by a SentencePiece vocabulary of merges.

Encoding is an agenda: every two adjacent symbols that together are a piece of
the vocabulary wait in it, best score first and leftmost of equals; the pair on
top becomes one symbol and meets its new neighbours, until no pair is left.
What is still no piece is spelled in bytes. The agenda is a heap, or over the
few symbols of a short word a list.

No piece has a space after another character, which is checked when a
vocabulary is loaded. So no pair reaches over a word's first space, words have
agendas of their own, and a word met again is looked up. The words not met
before step through their agendas together, each its own. The library encodes
every one of them too, and decodes every text. Ids are kept as packed bytes.
"""

from __future__ import annotations

import gc
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import compress, pairwise
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

SPACE = "▁"
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Spaces and the word after them, or spaces at the end; what holds for any vocabulary of words.
_WORDS = " *[^ ]+| +"
#: The same with Latin letters, digits and the rest apart, where no piece joins them: fewer words differ.
_KINDS = f" *[{_LETTER}]+|[0-9]| *[^ 0-9{_LETTER}]+| +"
_JOINED = f"[{_LETTER}][^{_LETTER}]|[^{SPACE}{_LETTER}][{_LETTER}]|.[0-9]|[0-9]."
#: Words a worker remembers, twice at most, and the longest of them in characters.
REMEMBERED, LONGEST = 250_000, 32
#: Characters cut into words at once; a longer text is taken in stretches that end where a word does.
STRETCH = 1 << 20
#: A character no vocabulary taken here has.
_APART = "①"
#: The rank of a pair that is no piece.
_NONE = (1 << 31) - 1
_BAD = "�".encode()


def _packed(ids) -> bytes:
    return array("i", ids).tobytes()


class _Seen(dict):
    """Words met of late, spaces plain, and their packed ids; the older half is forgotten when it is full."""

    def __init__(self, merge):
        self.merge, self.older = merge, {}
        self.new: list[str] = []  # words merged since they were last checked

    def __missing__(self, word: str) -> bytes:
        found = self.older.pop(word, None)
        if found is None:
            found = _packed(self.merge(word.replace(" ", SPACE)))
            self.new.append(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Vocabulary:
    """A merge-type model file, with the library beside it to check against."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        pieces = [lib.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        if any(SPACE in pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece spans words: their agendas are not apart")
        if lib.encode("①  a ", out_type=str)[-3:] != [SPACE, SPACE + "a", SPACE] or any(lib.is_unused(i) for i in plain):
            raise ValueError("only vocabularies of merges, without normalisation or unused pieces")
        joined = any(re.search(_JOINED, pieces[i], re.DOTALL) for i in plain)
        self.words = re.compile(_WORDS if joined else _KINDS).findall
        self.id_of = {pieces[i]: i for i in plain}
        if any(_APART in pieces[i] for i in plain):
            raise ValueError(f"{_APART} has to be no piece")
        order = {s: rank for rank, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        self.rank = {pieces[i]: order[lib.get_score(i)] for i in plain if len(pieces[i]) > 1}
        self.byte = {int(pieces[i][3:5], 16): i for i in ids if lib.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown = lib.unk_id()
        surface = [p.replace(SPACE, " ").encode() for p in pieces]
        for i in ids:
            if lib.is_control(i):
                surface[i] = b""
            elif lib.is_unknown(i):
                surface[i] = " ⁇ ".encode()
            elif lib.is_byte(i):
                surface[i] = bytes([self.value[i]])
        self.surface = surface
        self.ends = {i for i in ids if lib.is_control(i)}
        self.surfaces = pa.array(surface, pa.large_binary())
        self.is_end = np.array([i in self.ends for i in ids])
        #: Whether decoding leaves out an id's leading space where it comes first.
        self.leads = np.array([surface[i][:1] == b" " and i not in self.value and i != self.unknown for i in ids])
        self._set_pairs(len(pieces))
        self.ahead: dict[str, tuple[int, ...]] = {}
        self.seen = _Seen(self.merge)

    def _set_pairs(self, size: int) -> None:
        """Which two pieces are one by their ids, for words that step together."""
        self.filler = size  # no piece, and in no pair
        self.of_point = np.full(0x110000, size, np.int64)
        for piece, id in self.id_of.items():
            if len(piece) == 1:
                self.of_point[ord(piece)] = id
        pairs = {}
        for piece, rank in self.rank.items():
            for cut in range(1, len(piece)):
                left, right = self.id_of.get(piece[:cut]), self.id_of.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * (size + 1) + right] = rank, self.id_of[piece]
        keys = sorted(pairs)
        self.pairs = np.array([*keys, np.iinfo(np.int64).max])
        self.pair_rank = np.array([*(pairs[key][0] for key in keys), _NONE], np.int32)
        self.pair_id = np.array([*(pairs[key][1] for key in keys), size])

    def _paired(self, left, right):
        """The rank of each pair of ids, and the id of the two as one."""
        key = left * (self.filler + 1) + right
        at = self.pairs.searchsorted(key)
        at[self.pairs[at] != key] = len(self.pairs) - 1
        return self.pair_rank[at], self.pair_id[at]

    def together(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of those short words all of whose characters are pieces: every step takes the top of each agenda."""
        words = [word for word in words if len(word) <= LONGEST]
        if not words:
            return {}
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = int(size.max()) + 1  # one place more, which holds no piece and ends every word
        held = np.full((len(words), wide), self.filler)
        held[np.arange(wide) < size[:, None]] = self.of_point[points]
        known = (held != self.filler).sum(1) == size
        words, held, size = list(compress(words, known)), held[known], size[known]
        rows = np.arange(len(words))
        place = rows[:, None] * wide + np.arange(wide)
        rank = np.full(held.shape, _NONE, np.int32)
        fused = np.full(held.shape, self.filler)
        rank[:, :-1], fused[:, :-1] = self._paired(held[:, :-1], held[:, 1:])
        after, before = place + 1, place - 1
        after[rows, size - 1] = before[:, 0] = place[:, -1]
        held, after, before, ranks, fused = (x.reshape(-1) for x in (held, after, before, rank, fused))
        while rows.size:
            at = rows * wide + rank[rows].argmin(1)  # the leftmost of equals
            live = ranks[at] != _NONE
            rows, at = rows[live], at[live]
            gone, left, made = after[at], before[at], fused[at]
            right = after[gone]
            held[at], held[gone], ranks[gone] = made, self.filler, _NONE
            after[at], before[right] = right, at
            ranks[at], fused[at] = self._paired(made, held[right])
            ranks[left], fused[left] = self._paired(held[left], made)
        stay = (held != self.filler).reshape(-1, wide)
        ids = held[stay.reshape(-1)].tolist()
        bounds = [0, *np.cumsum(stay.sum(1)).tolist()]
        return {word: tuple(ids[a:b]) for word, (a, b) in zip(words, pairwise(bounds))}

    def merge(self, word: str) -> tuple[int, ...]:
        """The agenda over one word, if it is not already worked off."""
        return self.ahead.pop(word, None) or self._ids(self._short(word) if len(word) <= LONGEST else self._long(word))

    def _short(self, word: str) -> list[str]:
        """The agenda as a list with one place a pair: what a few symbols need."""
        entry = self.rank.get
        symbols = list(word)
        agenda = [entry(pair, _NONE) for pair in map(add, word, word[1:])]
        while agenda:
            top = min(agenda)
            if top == _NONE:
                break
            i = agenda.index(top)  # the leftmost of equals
            symbols[i] = left = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = entry(left + symbols[i + 1], _NONE)
            if i:
                agenda[i - 1] = entry(symbols[i - 1] + left, _NONE)
        return symbols

    def _long(self, word: str) -> list[str]:
        """The agenda as a heap, whose entries are checked when they come up."""
        rank = self.rank.get
        agenda = [(r, i, len(pair)) for i, pair in enumerate(map(add, word, word[1:])) if (r := rank(pair)) is not None]
        heapify(agenda)
        symbols = list(word)
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while agenda:
            _, i, size = heappop(agenda)
            left, j = symbols[i], after[i]
            if j >= n or not left:
                continue
            left += symbols[j]
            if len(left) != size:
                continue  # one of the two has merged since
            symbols[i], symbols[j] = left, ""
            after[i] = j = after[j]
            if j < n:
                before[j] = i
            for k, pair in ((i, left + symbols[j] if j < n else ""), (before[i], symbols[before[i]] + left if before[i] >= 0 else "")):
                r = rank(pair)
                if r is not None:
                    heappush(agenda, (r, k, len(pair)))
        return [s for s in symbols if s]

    def _ids(self, symbols: list[str]) -> tuple[int, ...]:
        out = []
        for s in symbols:
            id = self.id_of.get(s)
            if id is not None:
                out.append(id)
            elif self.byte:
                out.extend(map(self.byte.__getitem__, s.encode()))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str) -> tuple[list[int], bool]:
        """The ids of a text, and whether the library finds the same."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """The same for the texts of a batch."""
        return [(array("i", ids).tolist(), same) for ids, same in zip(*self.encode_packed(texts))]

    def encode_packed(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """The packed ids of each text, and whether the library finds the same.
        Words met for the first time are given to the library together; those
        seen before were."""
        parts, same = [[] for _ in texts], [True] * len(texts)
        for some in self._dealt(texts):
            differ = set().union(*[words for _, words in some])
            found = dict(zip(differ, map(self.seen.get, differ)))  # few enough to be at hand
            missed = [word for word, ids in found.items() if ids is None]
            self.ahead = self.together([word.replace(" ", SPACE) for word in missed if word not in self.seen.older])
            for word in missed:
                found[word] = self.seen[word]
            for n, words in some:
                parts[n].append(b"".join(map(found.__getitem__, words)))
            wrong = self._unlike()
            for n, words in some if wrong else ():
                same[n] &= wrong.isdisjoint(words)
        return [b"".join(p) for p in parts], same

    def _dealt(self, texts: list[str]):
        """(which text, words) of every stretch, as many at once as have about STRETCH characters."""
        some, size = [], 0
        for n, text in enumerate(texts):
            for stretch in stretches(text):
                some.append((n, self.words(" " + stretch.replace(SPACE, " "))))
                size += len(stretch)
                if size >= STRETCH:
                    yield some
                    some, size = [], 0
        yield some

    def _unlike(self) -> set[str]:
        """The words not yet checked of which the library makes something else."""
        new, self.seen.new = self.seen.new, []
        lead = len(self.library.encode(_APART))
        # Behind a character that is no piece and joins none, so no space is put before the word itself.
        theirs = self.library.encode([_APART + word for word in new], num_threads=1)
        wrong = {word for word, ids in zip(new, theirs) if _packed(ids[lead:]) != self.seen[word]}
        self.seen.new = []  # long words are merged once more
        for word in wrong:
            self.seen.pop(word, None)  # so that it is told again
            self.seen.older.pop(word, None)
        return wrong

    def decode(self, ids: list[int]) -> tuple[str, bool]:
        """The text of ids, and whether the library finds the same."""
        first = next((k for k, i in enumerate(ids) if i not in self.ends), len(ids))
        parts = list(map(self.surface.__getitem__, ids))
        if first < len(ids) and ids[first] not in self.value and parts[first][:1] == b" " and ids[first] != self.unknown:
            parts[first] = parts[first][1:]  # the space that encoding put before the text
        try:
            # A control id between spelled bytes parts them, though it writes nothing.
            text = b"".join(parts).decode() if self.ends.isdisjoint(ids) else self._mend(ids, parts)
        except UnicodeDecodeError:  # spelled bytes that are no text
            text = self._mend(ids, parts)
        return text, text == self.library.decode(ids)

    def decode_all(self, column: pa.ListArray) -> tuple[list[str | None], list[bool]]:
        """The texts of lists of ids, written at once, and whether the library finds the same of each."""
        rows = column.offsets.to_numpy()
        flat = column.values.slice(rows[0], rows[-1] - rows[0])
        rows = rows - rows[0]
        numbers = flat.to_numpy()
        written = self.surfaces.take(flat)
        view = memoryview(written.buffers()[2] or b"")
        bounds = np.frombuffer(written.buffers()[1], np.int64)[rows].tolist() if len(flat) else [0] * len(rows)
        ended = np.concatenate([[0], np.cumsum(self.is_end[numbers])])[rows].tolist()
        leads = self.leads[numbers[np.minimum(rows[:-1], len(numbers) - 1)]].tolist() if len(flat) else [False] * len(rows)
        listed, rows = numbers.tolist(), rows.tolist()
        texts, same = [], []
        for n, there in enumerate(column.is_valid().to_pylist()):
            ids = listed[rows[n] : rows[n + 1]]
            if not there:
                text, like = None, True
            elif ended[n] != ended[n + 1]:
                text, like = self.decode(ids)
            else:
                try:
                    text = str(view[bounds[n] + (leads[n] if ids else 0) : bounds[n + 1]], "utf-8")
                    like = text == self.library.decode(ids)
                except UnicodeDecodeError:
                    text, like = self.decode(ids)
            texts.append(text)
            same.append(like)
        return texts, same

    def _mend(self, ids: list[int], parts: list[bytes]) -> str:
        """Each spelled byte that is in no character of its run becomes U+FFFD."""
        out, run = [], bytearray()

        def close():
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append(_BAD.decode())
                at += n
            run.clear()

        for i, part in zip(ids, parts):
            if i in self.value:
                run += part
            else:
                close()
                out.append(part.decode())
        close()
        return "".join(out)


def stretches(text: str, size: int = STRETCH):
    """A text in stretches of about ``size`` characters, cut at spaces no piece
    reaches over. The space at a cut is left out: encoding puts one before
    every stretch."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1] in (" ", SPACE):  # only the first space after a word parts
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut == len(text) - 1:
            break
        yield text[at:cut]
        at = cut + 1
    if text:
        yield text[at:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def quietly(batches):
    """The batches without the collector of cycles, which finds none here but walks all words remembered."""
    gc.disable()
    try:
        yield from batches
    finally:
        gc.enable()


def _plain(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def encode(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ids (array of int) and same (the library finds the same ids) of every row.

    A null or empty text has no ids; bytes that are no UTF-8 count as U+FFFD.
    Rows with repeated or null ids are encoded each, and an empty table gives no
    rows. Only ``id`` and ``text`` are read, so other columns cannot clash.
    ``model`` is a path every executor has.
    """

    def run(batches):
        words = vocabulary(model)
        for batch in quietly(batches):
            found, same = words.encode_packed([x.decode(errors="replace") for x in _plain(batch.column(text))])
            ends = np.cumsum([0, *map(len, found)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(id), ids, pa.array(same, pa.bool_())], [id, "ids", "same"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(run, f"`{id}` {kind}, ids array<int>, same boolean")


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "decoded", same: str = "same_decoded") -> DataFrame:
    """``rows`` with the text of their ids in ``out`` and in ``same`` whether the library finds it too.

    Null ids give a null text, none give an empty one. The names of the two new
    columns must not be taken; the rest passes through.
    """
    taken = {c.lower() for c in rows.columns} & {out.lower(), same.lower()}
    if taken:
        raise ValueError(f"columns already there: {sorted(taken)}")

    def run(batches):
        words = vocabulary(model)
        for batch in quietly(batches):
            texts, like = words.decode_all(batch.column(ids))
            more = [pa.array(texts, pa.string()), pa.array(like, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, out, same])

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType()), T.StructField(same, T.BooleanType())])
    return rows.mapInArrow(run, schema)
