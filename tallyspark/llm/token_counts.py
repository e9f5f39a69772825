"""Operator 12: token counts by a finite-state transducer compiled from a byte-level BPE tokenizer with word ends.

The machine reads a text character by character; each transition carries the number of tokens that it adds (it may be
negative: a longer token can replace several). A state is what the future depends on: the kind of word that is open
(letters, other signs, an apostrophe that may begin a contraction), its last byte, which waits to learn whether the
word ends there, and the open places of the word, each with a node of the vocabulary's trie, the last token of the
encoding up to that place, and that encoding's tokens against the present ones. That is enough, since BPE is settled
by pairs: the encoding of a longer prefix is the encoding up to some place and one token more, and the one such token
is valid that would not have been merged with the token before it. States are finite (places go back no further than
the longest token) and are determinized as texts reach them, kept up to a bound and made again after it. White space leads
every state back to the first one, so what a stretch between two spaces adds is kept too, as one transition.

Texts longer than a piece are cut anywhere. A piece's map from entry state to exit state and tokens is its head (up to
the first character after which every entry state has become the same) and what follows from there; maps compose,
associatively, in two rounds of a scan over the pieces of a text: within blocks of 64, then over blocks.

Characters are folded and classed by asking the tokenizer's own normalizer and splitter, so they agree by construction.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import partitions

VOCABULARY = "word_bpe_49k.json"
#: Characters of a piece; transitions that a worker keeps.
PIECE, KEPT = 1 << 15, 1 << 19
LIMIT = 2048
#: Fixed: the endings that the tokenizer's splitter takes together with their apostrophe.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_START = ("start",)
_NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte, as byte-level vocabularies write it: printable bytes stand for themselves, the
    others follow from 256 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The vocabulary: a trie over symbols (a byte, or 256 and a byte that ends its word), and which tokens may stand
    side by side."""

    def __init__(self, model: dict) -> None:
        letters, end = _byte_letters(), model["end_of_word_suffix"]

        def symbols(token: str) -> list[int]:
            ends = token.endswith(end)
            out = [letters[c] for c in (token[: -len(end)] if ends else token)]
            return [*out[:-1], out[-1] + 256] if ends else out

        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.ids = dict(model["vocab"])
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        for rank, (left, right) in enumerate(pairs):
            a, b, whole = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank[a, b] = rank
            self.made.setdefault(whole, (rank, a, b))
        nodes: dict[int, int] = {}  # node << 9 | symbol: node
        inner, whole_at = set(), {}
        for token, number in self.ids.items():
            node = 0
            for symbol in symbols(token):
                inner.add(node)
                node = nodes.setdefault(node << 9 | symbol, len(nodes) + 1)
            whole_at[node] = number
        self.valid: dict[int, bool] = {}
        self.apart: dict[int, bool] = {}
        #: node << 9 | symbol: next node << 22 | (token + 1, or 0 if none is valid there) << 1 | whether it goes on.
        self.trie = {}
        for step, node in nodes.items():
            token = whole_at.get(node, -1)
            ends = token + 1 if token >= 0 and self.is_valid(token) else 0
            self.trie[step] = node << 22 | ends << 1 | (node in inner)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that the left (1) or right (2) edge of a token goes through while it is merged, each with the rank
        of the merge that ends it."""
        out, until = [], _NEVER
        while True:
            out.append((token, until))
            if token not in self.made:
                return out[::-1]
            until = self.made[token][0]
            token = self.made[token][side]

    def untouched(self, left: int, right: int) -> bool:
        """Whether no merge joins the two before each is whole. Merges go by rank, of equal ones the leftmost first."""
        a, b = self.edge(left, 2), self.edge(right, 1)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            across = self.rank.get((x, y), _NEVER)
            if x_until == y_until == _NEVER:
                return True
            if across < x_until and across <= y_until:
                return False
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def is_valid(self, token: int) -> bool:
        """Whether the token's own bytes are merged to it."""
        if token not in self.valid:
            parts = self.made.get(token)
            self.valid[token] = parts is None or (self.is_valid(parts[1]) and self.is_valid(parts[2]) and self.untouched(*parts[1:]))
        return self.valid[token]

    def stay_apart(self, key: int) -> bool:
        """Whether the encoding of two tokens' bytes is the two tokens (first + 1 << 20 | second + 1)."""
        left, right = (key >> 20) - 1, (key & 0xFFFFF) - 1
        if len(self.apart) > KEPT:
            self.apart.clear()
        self.apart[key] = known = (left, right) not in self.rank and self.untouched(left, right)
        return known

    def step(self, places: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
        """The open places after one more symbol of a word, longest first, and the tokens it adds.

        A place is node << 28 | (last token + 1) << 8 | 128 + its tokens against the present ones.
        """
        trie, grown, last = self.trie, [], -1
        for place in places:
            found = trie.get(place >> 28 << 9 | symbol)
            if found is None:
                continue
            if last < 0 and (token := found >> 1 & 0x1FFFFF):
                before = place >> 8 & 0xFFFFF
                if before:
                    apart = self.apart.get(before << 20 | token)
                    if apart is None:
                        apart = self.stay_apart(before << 20 | token)
                if not before or apart:
                    last, added = token, (place & 255) - 127
            if found & 1:
                grown.append(found >> 22 << 28 | place & 0xFFFFFFF)
        if last < 0:
            raise ValueError("a byte without a token")
        return (*[g - added for g in grown], last << 8 | 128), added


#: These are no white space to the tokenizer, though Python takes them for it.
_NO_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"\s")


class Stretches(dict):
    """Tokens of stretches without white space, from the first state to the close; up to a bound."""

    def __init__(self, made: Machine) -> None:
        super().__init__()
        self.made = made

    def __missing__(self, stretch: str) -> int:
        n, state = self.made.read(_START, stretch)
        if len(stretch) > 64:
            return n + self.made.close(state)
        if len(self) >= KEPT:
            self.clear()
        self[stretch] = n = n + self.made.close(state)
        return n


#: A word's beginning: one place, at the root, after no token.
_NEW = (128,)


class Machine:
    """The transducer: `run(state, text)` gives tokens added and the next state; states are dicts of transitions, their
    description under None."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.merges = Merges(described["model"])
        self.special = re.compile("|".join(map(re.escape, sorted((t["content"] for t in described["added_tokens"]), key=len, reverse=True))))
        self.states: dict[tuple, dict] = {}
        self.kept = 0
        self.stretches = Stretches(self)
        self.folds: dict[str, list[tuple[str, str]]] = {}

    def fold(self, c: str) -> list[tuple[str, str]]:
        """The normalized characters of one character, each with its class: L letter, N number, O other, S space."""
        if c not in self.folds:
            split = lambda s: [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(s)]
            out = []
            for x in self.library.normalizer.normalize_str(c):
                kind = "S" if not split(x) else "L" if len(split("a" + x)) == 1 else "O" if len(split("!" + x)) == 1 else "N"
                out.append((x, kind))
            self.folds[c] = out
        return self.folds[c]

    def segments(self, text: str) -> list[str]:
        """What stands between special tokens, composed as the tokenizer composes it."""
        parts = self.special.split(text) if "<" in text else [text]
        return [p if p.isascii() or unicodedata.is_normalized("NFC", p) else _composed(p) for p in parts]

    def _word(self, word: str) -> int:
        data = word.encode()
        places, n = _NEW, 0
        for byte in data[:-1]:
            places, added = self.merges.step(places, byte)
            n += added
        return n + self.merges.step(places, data[-1] + 256)[1]

    def close(self, state: tuple) -> int:
        """Tokens that the open word adds if it ends here."""
        if state == _START:
            return 0
        if state[0] == "'":
            return self._word("'") + (self._word(state[1][1:]) if len(state[1]) > 1 else 0)
        return self.merges.step(state[1], state[2] + 256)[1]

    def _read(self, state: tuple, c: str, kind: str) -> tuple[int, tuple]:
        """Tokens added and next state for a normalized character."""
        if state[0] == "'":
            held = state[1] + c
            if held in CONTRACTIONS:
                return self._word(held), _START
            if any(x.startswith(held) for x in CONTRACTIONS):
                return 0, ("'", held)
            if len(held) == 2 and kind == "O":
                n, opened = self._open("O", "'")
                more, then = self._read(opened, c, kind)
                return n + more, then
            n = self._word("'")
            if len(held) == 3:
                more, state = self._open("L", held[1])
                n += more
            else:
                state = _START
            more, then = self._read(state, c, kind)
            return n + more, then
        if kind == state[0]:
            places, pending, n = state[1], state[2], 0
            for byte in c.encode():
                places, added = self.merges.step(places, pending)
                n, pending = n + added, byte
            return n, (kind, places, pending)
        n = self.close(state)
        if kind == "S":
            return n, _START
        if kind == "N":
            return n + self._word(c), _START
        if c == "'":
            return n, ("'", c)
        more, then = self._open(kind, c)
        return n + more, then

    def _open(self, kind: str, c: str) -> tuple[int, tuple]:
        data, places, n = c.encode(), _NEW, 0
        for byte in data[:-1]:
            places, added = self.merges.step(places, byte)
            n += added
        return n, (kind, places, data[-1])

    def state(self, description: tuple) -> dict:
        found = self.states.get(description)
        if found is None:
            found = self.states[description] = {None: description}
        return found

    def _add(self, state: dict, c: str) -> tuple[int, dict]:
        now, n = state[None], 0
        for x, kind in self.fold(c):
            more, now = self._read(now, x, kind)
            n += more
        self.kept += 1
        if self.kept > KEPT:
            for old in self.states.values():
                name = old[None]
                old.clear()
                old[None] = name
            self.states, self.kept = {}, 0
            return n, self.state(now)
        state[c] = made = n, self.state(now)
        return made

    def read(self, state: tuple, text: str) -> tuple[int, tuple]:
        """`run`, character by character."""
        at, n = self.state(state), 0
        for c in text:
            step = at.get(c) or self._add(at, c)
            n += step[0]
            at = step[1]
        return n, at[None]

    def run(self, state: tuple, text: str) -> tuple[int, tuple]:
        """Tokens that a text adds from a state on, and the state after it."""
        first = None if _NO_SPACE.search(text) else _SPACE.search(text)
        if first is None:
            return self.read(state, text)
        n, opened = self.read(state, text[: first.start()])
        n += self.close(opened)
        middle = text[first.start() :].split()
        last = "" if text[-1].isspace() else middle.pop()
        n += sum(map(self.stretches.__getitem__, middle))
        more, then = self.read(_START, last)
        return n + more, then

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        parts = self.segments(text)
        total = len(parts) - 1
        for part in parts:
            n, state = self.run(_START, part)
            total += n + self.close(state)
        return total

    def head(self, text: str) -> int:
        """Characters after which every entry state has become the same, or 0 if none has."""
        before, before_kind = "", ""
        for i, c in enumerate(text):
            for x, kind in self.fold(c):
                reset = kind in "SN" or (x != "'" and before != "'" and {kind, before_kind} == {"L", "O"})
                before, before_kind = x, kind
            if reset:
                return i + 1
        return 0

    def piece_map(self, text: str) -> tuple[str, int, tuple | None]:
        """Head, and tokens and exit state of what follows it; a piece that never resets is all head, without exit."""
        at = self.head(text)
        if not at:
            return text, 0, None
        # the state after the head is that after its last two characters
        _, state = self.run(_START, text[max(0, at - 2) : at])
        n, state = self.run(state, text[at:])
        return text[:at], n, state

    def compose(self, one: tuple, two: tuple) -> tuple:
        """The map of two pieces that follow each other."""
        head, n, state = one
        if state is None:
            return head + two[0], two[1], two[2]
        more, then = self.run(state, two[0])
        return head, n + more + two[1], two[2] if two[2] is not None else then


def _composed(text: str) -> str:
    from tokenizers.normalizers import NFC

    return NFC().normalize_str(text)


@lru_cache(maxsize=2)
def machine(vocabulary: str) -> Machine:
    """One machine a worker and vocabulary: a file's path, or the name of a public tokenizer."""
    if "/" not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return Machine(vocabulary)


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = machine(vocabulary)
        for batch in batches:
            counts = [made.count(t.as_py()) if t.is_valid else 0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


_PIECES = "row long, doc_id long, n_bytes long, segment long, piece long, text string"
_MAPS = "row long, doc_id long, n_bytes long, segment long, piece long, head string, n long, exit string"
_KINDS = {"long": pa.int64(), "string": pa.string()}


def _arrow(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in ddl.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _cut_pieces(vocabulary: str, size: int):
    """The pieces of each text. Special tokens cut it into segments, which do not touch each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = machine(vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(k)[i].as_py() for k in range(3))
                for number, segment in enumerate(made.segments(batch.column(3)[i].as_py())):
                    yield _arrow(_PIECES, [(*key, number, at // size, segment[at : at + size]) for at in range(0, max(len(segment), 1), size)])

    return run


def _written(state: tuple | None) -> str | None:
    return None if state is None else json.dumps(state)


def _read_state(text: str | None) -> tuple | None:
    deep = lambda x: tuple(map(deep, x)) if isinstance(x, list) else x
    return None if text is None else deep(json.loads(text))


def _map_pieces(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = machine(vocabulary)
        for *key, text in _rows(batches):
            head, n, state = made.piece_map(text)
            yield _arrow(_MAPS, [(*key, head, n, _written(state))])

    return run


def _compose(vocabulary: str, block: int):
    """The map of every `block` consecutive pieces of a segment, from rows sorted by row, segment and piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = machine(vocabulary)
        key, now, out = None, None, []
        for *place, piece, head, n, state in _rows(batches):
            mine = (*place, piece // block)
            one = (head, n, _read_state(state))
            if mine == key:
                now = made.compose(now, one)
                continue
            if key is not None:
                out.append((*key, now[0], now[1], _written(now[2])))
            key, now = mine, one
            if len(out) >= 512:
                yield _arrow(_MAPS, out)
                out = []
        if key is not None:
            out.append((*key, now[0], now[1], _written(now[2])))
            yield _arrow(_MAPS, out)

    return run


def _finish(vocabulary: str):
    """Tokens of whole segments: their maps applied to the state in which a text begins, and closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = machine(vocabulary)
        for row, doc_id, n_bytes, _, _, head, n, state in _rows(batches):
            _, total, end = made.compose(("", 0, _START), (head, n, _read_state(state)))
            yield _arrow("row long, doc_id long, n_bytes long, n long", [(row, doc_id, n_bytes, total + made.close(end))])

    return run


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, piece: int = PIECE, block: int = 64) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Tokens are those of the tokenizer's own library without added ones; special tokens' strings inside a text are
    one token each, as by its default. Null and empty texts have no bytes and no tokens. Each row is counted by
    itself, whatever its doc_id (null and repeated ones too); other columns are ignored. A text of more than `piece`
    characters is cut into pieces that are read on any executor; a stretch that never resets (one word or row of
    signs longer than a piece) is read where its entry state is known.
    """
    n = partitions(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    is_long = F.coalesce(F.length("text") > piece, F.lit(False))
    short = rows.where(~is_long).mapInArrow(_count(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    numbered = rows.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "text")
    pieces = numbered.mapInArrow(_cut_pieces(vocabulary, piece), _PIECES).repartition(n, "row", "segment", "piece")
    maps = pieces.mapInArrow(_map_pieces(vocabulary), _MAPS)
    for size in (block, 1 << 62):
        place = F.floor(F.col("piece") / size)
        maps = maps.repartition(n, "row", "segment", place).sortWithinPartitions("row", "segment", "piece").mapInArrow(_compose(vocabulary, size), _MAPS)
    segments = maps.mapInArrow(_finish(vocabulary), "row long, doc_id long, n_bytes long, n long")
    # between two segments stands one special token
    long = segments.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), (F.sum("n") + F.count(F.lit(1)) - 1).alias("n_tokens"))
    return short.unionByName(long.drop("row")).withColumn("over_limit", F.col("n_tokens") > limit)
