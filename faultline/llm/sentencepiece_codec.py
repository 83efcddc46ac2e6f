"""SentencePiece BPE encoding and decoding through a table of prefixes.

For merge-type vocabularies every prefix of a text has exactly one last token
in its encoding.  An automaton over all pieces lists the pieces that end at a
position; the right one is that whose pairing with the last token of the rest
before it is stable, meaning that merging would never have crossed the border.
The table holds one token per prefix, and the ids are read from its end back.

Merges never cross the border before a run of white space, because no piece
has the white-space mark behind another character (checked on loading).  Texts
are therefore cut there, and the table is built once for each distinct word.
A word is cut again between characters that no piece connects, as letters and
most punctuation: the parts are fewer, and repeat more often, than the words.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import short_batches

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# distinct words a worker remembers in each of two generations, and pairs before it starts afresh
MEMO_WORDS = 200_000
MEMO_PAIRS = 1_000_000
LONGEST_REMEMBERED = 64


class Codec:
    """Encoder and decoder for one model file; the file is read, never trained."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            self._library = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        lib, size = self._library, self._library.get_piece_size()
        self.end_id, self._unknown = lib.eos_id(), lib.unk_id()
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[piece] = i
        self.pieces = {i: p for p, i in self.ids.items()}
        self.scores = {i: lib.get_score(i) for i in self.pieces}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has the white-space mark inside: texts can't be cut at white space")
        if len(self.bytes) not in (0, 256):
            raise ValueError("byte pieces are incomplete")
        self._from_byte = {i: b for b, i in self.bytes.items()}
        self._digits = [str(i) for i in range(size)]
        self._parts = re.compile(f"{MARK}*(?:{'|'.join([*_connected(self.ids), f'[^{MARK}]'])})|{MARK}+")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            # a piece that merging can't build on its own never stands in an encoding
            if len(piece) == 1 or self._merge(piece) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self._order, self._halves, self._tied = self._merges()
        self._words: dict[str, tuple[str, int, str]] = {}
        self._older: dict[str, tuple[str, int, str]] = {}
        self._pairs: dict[int, bool] = {}

    def _merges(self) -> tuple[dict[str, int], dict[str, tuple[str, str]], re.Pattern]:
        """Pieces in the order merging takes them, single characters first; the two that each was last merged from; those whose score repeats.

        Where scores repeat the order depends on the place in the text, too.
        """
        long = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.scores[self.ids[p]])
        times = Counter(self.scores[self.ids[p]] for p in long)
        tied = [re.escape(p) for p in long if times[self.scores[self.ids[p]]] > 1]
        order = {p: n for n, p in enumerate([*(p for p in self.ids if len(p) == 1), *long])}
        halves = {p: tuple(self._merge(p, whole=False)) for p in long if p in self.automaton}
        return order, halves, re.compile("|".join(tied) or "(?!)")

    def _merge(self, text: str, whole: bool = True) -> list[str]:
        """Symbols left after merging the best-scored neighbours again and again; for short strings.

        With ``whole`` false the merge that would join the whole text is left out.
        """
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if a >= 0 and b < len(parts):
                joined = parts[a] + parts[b]
                if joined in self.ids and (whole or joined != text):
                    heapq.heappush(queue, (-self.scores[self.ids[joined]], a, b, joined))

        for a in range(len(parts) - 1):
            offer(a)
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [p for p in parts if p is not None]

    def _stable(self, left: int, right: int) -> bool:
        """Whether two pieces beside each other stay as they are: no merge crosses their border."""
        pair = left << 32 | right
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self._pairs[pair] = self._merge(a + b) == [a, b] if self._tied.search(a + b) else self._apart(a, b)
        return known

    def _apart(self, a: str, b: str) -> bool:
        """Stability of two pieces by undoing their merges, the latest first: what stood at the border then must not have merged earlier."""
        order, halves = self._order, self._halves
        left, right = order[a], order[b]
        limit = len(order)
        while True:
            if order.get(a + b, limit) < limit:
                return False
            # of two equal pieces the left one is merged first
            if (left > right or b not in halves) and a in halves:
                limit, a = left, halves[a][1]
                left = order[a]
            elif b in halves:
                limit, b = right + 1, halves[b][0]
                right = order[b]
            else:
                return True

    def last_tokens(self, word: str) -> list[int]:
        """The table: for each prefix of ``word`` the last id of its encoding, -1 for a character without a piece."""
        table: list[int] = []
        done, stable, known = 0, self._stable, self._pairs.get
        for at, (piece, length) in self.automaton.iter(word):  # at one end, longest piece first
            if done > at:
                continue
            while done < at:
                table.append(-1)
                done += 1
            rest = at - length
            if length > 1 and rest >= 0 and (left := table[rest]) >= 0:
                fits = known(left << 32 | piece)
                if not (stable(left, piece) if fits is None else fits):
                    continue
            table.append(piece)
            done += 1
        return table + [-1] * (len(word) - done)

    def _word_ids(self, word: str) -> list[int]:
        table, out, at, pieces = self.last_tokens(word), [], len(word), self.pieces
        while at:
            last = table[at - 1]
            if last >= 0:
                out.append(last)
                at -= len(pieces[last])
                continue
            at -= 1
            if self.bytes:
                out.extend(self.bytes[b] for b in reversed(word[at].encode("utf-8")))
            else:
                out.append(self._unknown)
        out.reverse()
        return out

    def _word(self, word: str) -> tuple[str, int, str]:
        known = self._older.get(word)
        if known is None:
            parts = self._parts.findall(word)
            if len(parts) > 1:
                found = [self._words.get(p) or self._word(p) for p in parts]
                known = (" ".join([f[0] for f in found]), sum([f[1] for f in found]), "".join([f[2] for f in found]))
            else:
                ids = self._word_ids(word)
                known = (" ".join([self._digits[i] for i in ids]), len(ids), self._surface(ids))
        if len(word) <= LONGEST_REMEMBERED:
            if len(self._words) >= MEMO_WORDS:
                self._older, self._words = self._words, {}
            self._words[word] = known
        return known

    def _surface(self, ids: list[int]) -> str:
        """What ids stand for, the white-space mark as a space; byte runs are read as UTF-8."""
        pieces = self.pieces
        try:
            return "".join([pieces[i] for i in ids]).replace(MARK, " ")
        except KeyError:  # bytes, control or unknown ids among them
            pass
        out, run = [], bytearray()
        for i in [*ids, None]:
            byte = self._from_byte.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i in pieces:
                out.append(pieces[i].replace(MARK, " "))
            elif i == self._unknown:
                out.append(self._library.decode([i]))
        return "".join(out)

    def words(self, text: str) -> list[str]:
        """Normalised by the model's own rules (white space marked), cut where no merge can cross."""
        return WORD.findall(self._library.normalize(text))

    def encode(self, text: str, end: bool = True) -> list[int]:
        return [i for word in self.words(text) for i in self._word_ids(word)] + [self.end_id] * end

    def decode(self, ids: list[int]) -> str:
        """As the library: control ids are silent, the space put before the text is taken off."""
        text = self._surface(ids)
        return text[1:] if text.startswith(" ") else text

    def encoded(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, the ids as decimal text, and the decoded text."""
        known, found = self._words.get, []
        for word in self.words(text):
            found.append(known(word) or self._word(word))
            known = self._words.get
        ids = " ".join([*(f[0] for f in found), str(self.end_id)])
        surface = "".join(f[2] for f in found)
        return sum(f[1] for f in found) + 1, ids, surface[1:] if surface.startswith(" ") else surface


def _connected(pieces: Iterable[str]) -> list[str]:
    """Patterns for runs of characters that stand together in pieces, directly or through others; the white-space mark aside."""
    group: dict[str, set[str]] = {}
    for piece in pieces:
        met = set(piece) - {MARK}
        if len(piece.lstrip(MARK)) < 2 or len({id(group.get(x)) for x in met}) == 1 and not met.isdisjoint(group):
            continue
        joined = met.union(*(group[x] for x in met if x in group))
        group.update(dict.fromkeys(joined, joined))
    return [f"[{re.escape(''.join(sorted(x)))}]+" for x in {id(x): x for x in group.values()}.values()]


def _utf8(run: bytes) -> str:
    """UTF-8 with one replacement character for each byte that can't be read."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256, and ``ids`` (array) if asked for.

    ``model`` is a path that every executor can read.  A null text counts as
    empty and has only the end id.  Rows are independent: repeated rows give
    repeated results, an empty table none, other columns take no part.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model)
        for batch in batches:
            found = [own.encoded(t if isinstance(t, str) else "") for t in batch["text"]]
            out = {
                "key": batch["key"],
                "n_tokens": [f[0] for f in found],
                "ids_sha256": [hashlib.sha256(f[1].encode()).hexdigest() for f in found],
                "decoded_sha256": [hashlib.sha256(f[2].encode()).hexdigest() for f in found],
            }
            if with_ids:
                out["ids"] = [[int(i) for i in f[1].split()] for f in found]
            yield pd.DataFrame(out)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * with_ids
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, schema).withColumnRenamed("key", key)
