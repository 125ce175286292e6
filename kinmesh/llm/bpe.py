"""Byte-pair encoding pieces shared by token counts (merge lists) and the codec (ranks).

Nothing here touches Spark; the operators run these helpers inside tasks.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import gc
import heapq
import json
import re
import struct
from array import array
from collections.abc import Callable, Iterable

import regex

#: Fixed pattern of the byte-level vocabularies; public_tokenizers.PATTERN states the same.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in blob.splitlines() if line)}


def piece_finder() -> Callable[[str], list[str]]:
    """A function that returns the matches of PATTERN in a text.

    Texts without characters beyond the basic plane go through the standard library's faster
    engine, with the classes of PATTERN written out as ranges; all others through ``regex``.
    """
    plane = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)

    def ranges(kind: str) -> str:
        runs = (m[0] for m in regex.finditer(kind + "+", plane))
        return "".join(re.escape(r[0]) + ("-" + re.escape(r[-1]) if len(r) > 1 else "") for r in runs)

    letter, number, space = map(ranges, (r"\p{L}", r"\p{N}", r"\s"))
    words = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+"
    fast, whole = re.compile(rf"{words}| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall, regex.compile(PATTERN).findall
    return lambda text: fast(text) if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else whole(text)


class Deferred:
    """Sent in place of an object that each worker builds from ``args`` when it first asks for it.

    A worker keeps a broadcast's value while its tasks use it and drops it with the first
    task that does not, so what it has built goes with it.
    """

    def __init__(self, kind: Callable, *args):
        self.kind, self.args = kind, args

    def __reduce__(self):
        return built, (self.kind, self.args)


def built(kind: Callable, args: tuple):
    """Build, and take tables of many small objects out of the collector's view."""
    made = kind(*args)
    gc.freeze()
    return made


def trim() -> None:
    """Give freed memory back to the system where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Memo(dict):
    """A dictionary that computes what it misses and holds two generations of at most ``size`` entries.

    When the young generation is full it becomes the old one; what is still asked
    for moves back, so frequent keys survive. Keys longer than ``longest`` are computed each
    time, so memory is bounded in bytes. Subclasses define ``compute``.
    """

    def __init__(self, size: int, longest: int = 48):
        super().__init__()
        self.size, self.longest, self.old = size, longest, {}

    def compute(self, key):
        raise NotImplementedError

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def merge(parts: list, rank: Callable, least: int = 1) -> list:
    """Greedy BPE: join the adjacent pair of lowest rank, leftmost first, until none has a rank or ``least`` parts are left.

    Short rows are searched anew after each join; long ones keep their pairs in a heap over
    linked neighbours, so that the cost is n log n.
    """
    if len(parts) > 64 and least == 1:
        return merge_long(parts, rank)
    while len(parts) > least:
        best, at = None, -1
        for k in range(len(parts) - 1):
            r = rank((parts[k], parts[k + 1]))
            if r is not None and (best is None or r < best):
                best, at = r, k
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def merge_long(parts: list, rank: Callable) -> list:
    """:func:`merge` by a heap of (rank, place); an entry counts only while both its parts stand as they did."""
    n = len(parts)
    after, before, heap = [*range(1, n), -1], list(range(-1, n - 1)), []

    def offer(k: int) -> None:
        r = rank((parts[k], parts[after[k]]))
        if r is not None:
            heap.append((r, k, parts[k], parts[after[k]])) if building else heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))

    building = True
    for k in range(n - 1):
        offer(k)
    building = False
    heapq.heapify(heap)
    while heap:
        _, k, left, right = heapq.heappop(heap)
        j = after[k]
        if parts[k] is not left or j < 0 or parts[j] is not right:
            continue
        parts[k], parts[j] = left + right, None
        after[k] = after[j]
        if after[k] >= 0:
            before[after[k]] = k
            offer(k)
        if before[k] >= 0:
            offer(before[k])
    return [x for x in parts if x is not None]


class Sizes(Memo):
    """Tokens of a pre-token: 1 for those proved whole, merged else."""

    def __init__(self, ranks: dict, whole: set[bytes], size: int):
        super().__init__(size)
        self.ranks, self.whole = ranks, whole

    def compute(self, piece: str) -> int:
        data = piece.encode()
        return 1 if data in self.whole else len(merge([data[i : i + 1] for i in range(len(data))], self.ranks.get))


class MergeCounter:
    """Token counts under a merge list, with the whole-token shortcut.

    ``whole`` holds the vocabulary strings proved to encode alone as one token; a
    pre-token among them counts as 1 with a set lookup. Only the others are merged. The proof
    is made once, where the counter is made; workers get its outcome.
    """

    def __init__(self, blob: bytes, cache: int = 100_000):
        spec = json.loads(blob)
        model = spec["model"]
        kind = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without prefix space or normaliser is needed")
        byte = byte_alphabet()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        raw = lambda s: bytes(byte[c] for c in s)
        ranks: dict = {}
        for k, (a, b) in enumerate(pairs):
            ranks.setdefault((raw(a), raw(b)), k)
        special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        whole = self.prove((raw(s) for s in model["vocab"] if all(c in byte for c in s)), ranks)
        self.state = ranks, whole, special, cache
        self.__setstate__(self.state)

    @staticmethod
    def prove(tokens: Iterable[bytes], ranks: dict) -> set[bytes]:
        """Vocabulary strings that the merges alone build back into one token."""
        return {t for t in tokens if len(merge([t[i : i + 1] for i in range(len(t))], ranks.get)) == 1}

    def __getstate__(self) -> tuple:
        return self.state

    def __setstate__(self, state: tuple) -> None:
        self.state = ranks, self.whole, self.special, cache = state
        self.find = piece_finder()
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if self.special else None
        self.sizes = Sizes(ranks, self.whole, cache)

    def count(self, text: str) -> int:
        if self.cut is not None and any(s in text for s in self.special):
            spans = self.cut(text)
            return len(spans) - 1 + sum(map(self.plain, spans))
        return self.plain(text)

    def plain(self, text: str) -> int:
        return sum(map(self.sizes.__getitem__, self.find(text)))


class Transducer:
    """BPE by ranks as a finite-state transducer, determinised when first needed.

    Two facts about BPE make it finite. A stretch of an encoding's tokens is the
    encoding of its own bytes, and a row of tokens is an encoding if and only if each
    neighbouring pair encodes as itself. So every prefix of a piece has one encoding,
    and whether a token may follow depends on the token before it alone.

    The non-deterministic machine has a state for each place where a token may have
    begun: the token before that place and the bytes read since, a node of the tokens' trie.
    A determinised state is the row of live places, each packed as one number. Reading a byte
    drops the places that no token can continue and adds the one place after it, which
    names the token that ends there. The tokens of a piece are then read from its end
    backwards, so a state holds nothing of what was decided before its places, and pieces
    with different beginnings share their states. A place lives no longer than the
    longest token, so states are bounded in size.

    The table holds at most ``states`` determinised states. When it is full it is dropped
    between two pieces and filled anew by what the next texts need.
    """

    #: A place is the token before it, plus one, times 2 ** NODE, and the node of the bytes read since.
    NODE = 32
    START = bytes(8)

    def __init__(self, ranks: dict[bytes, int], states: int = 200_000):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        #: The trie: node times 256 plus byte to the next node; the token that a node spells, or -1; whether a node has others below.
        self.down: dict[int, int] = {}
        self.spelt, self.inner = array("q", [-1]), bytearray(1)
        for t, r in ranks.items():
            node = 0
            for byte in t:
                self.inner[node] = 1
                below = self.down.setdefault(node << 8 | byte, len(self.spelt))
                if below == len(self.spelt):
                    self.spelt.append(-1)
                    self.inner.append(0)
                node = below
            self.spelt[node] = r
        self.limit = states
        #: The two tokens that the last join of a token put together; None for bytes and for strings that no joins make.
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.restart()

    def restart(self) -> None:
        #: The states' places, packed.
        self.states = [self.START]
        self.ids = {self.START: 0}
        #: The token that ends where a state is reached.
        self.ends = array("q", [-1])
        #: State times 256 plus byte to the next state.
        self.moves: dict[int, int] = {}

    def halves_of(self, token: int) -> tuple[int, int] | None:
        if token not in self.halves:
            data, get = self.bytes_of[token], self.ranks.get
            parts = merge([data[i : i + 1] for i in range(len(data))], lambda p: get(p[0] + p[1]), 2)
            self.halves[token] = (get(parts[0]), get(parts[1])) if len(parts) == 2 else None
        return self.halves[token]

    def may_stand(self, token: int) -> bool:
        """Whether the token's bytes alone encode as itself."""
        return len(self.bytes_of[token]) == 1 or self.halves_of(token) is not None

    def fit(self, a: int, b: int) -> bool:
        """Whether two tokens side by side encode as themselves.

        The joins that made them are undone from the last back to the first. While two parts
        meet at the border, a join of both would have come before the next undone one if its
        rank is lower; of equal ranks the left place joins first.
        """
        until, get, data, known = float("inf"), self.ranks.get, self.bytes_of, self.halves
        while True:
            both = get(data[a] + data[b])
            if both is not None and both < until:
                return False
            left = known[a] if a in known else self.halves_of(a)
            right = known[b] if b in known else self.halves_of(b)
            if left is not None and (right is None or a > b):
                until, a = a, left[1]
            elif right is not None:
                until, b = b + 1, right[0]
            else:
                return True

    def advance(self, state: bytes, byte: int) -> tuple[int, bytes]:
        """(the token that ends after the byte, next determinised state)."""
        live, end, down = [], -1, self.down.get
        for place in struct.unpack(f"{len(state) // 8}q", state):
            node = place & (1 << self.NODE) - 1
            below = down(node << 8 | byte)
            if below is None:
                continue
            if end < 0 and (token := self.spelt[below]) >= 0 and self.may_stand(token):
                last = place >> self.NODE
                if not last or self.fit(last - 1, token):
                    end = token
            if self.inner[below]:
                live.append(place ^ node | below)
        if end < 0:
            raise ValueError("the ranks lack a single byte")
        live.append(end + 1 << self.NODE)
        return end, struct.pack(f"{len(live)}q", *live)

    def determinise(self, state: int, byte: int) -> int:
        end, key = self.advance(self.states[state], byte)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            self.ends.append(end)
        self.moves[state << 8 | byte] = found
        return found

    def traced(self, ends: list[int]) -> list[int]:
        """The tokens of a piece from those that end after each of its bytes."""
        out, at, data = [], len(ends), self.bytes_of
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= len(data[token])
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) >= self.limit:
            self.restart()
        told: list[int] = []
        state, get, ends = 0, self.moves.get, self.ends
        for byte in piece:
            move = get(state << 8 | byte)
            if move is None:
                if len(self.states) >= self.limit + 4096:  # a piece that would fill the table alone is read without it
                    return self.encode_alone(piece)
                move = self.determinise(state, byte)
            state = move
            told.append(ends[state])
        return self.traced(told)

    def encode_alone(self, piece: bytes) -> list[int]:
        """:meth:`encode` from state to state, none of which is kept."""
        told: list[int] = []
        state = self.START
        for byte in piece:
            end, state = self.advance(state, byte)
            told.append(end)
        return self.traced(told)


class Utf8Decoder:
    """Streaming UTF-8: fed bytes in any cut, it returns the text that is complete so far.

    Between feeds it holds the bytes of one unfinished character, three at most. The
    state machine :meth:`pending` reads the last bytes to see whether they begin a
    character that more bytes could finish. Malformed bytes become U+FFFD, one for each
    maximal part that could have begun a character.
    """

    #: First continuation bytes allowed after lead bytes that narrow them; others take 80 to BF.
    NARROW = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}

    def __init__(self):
        self.held = b""

    def pending(self, data: bytes) -> int:
        """How many bytes at the end begin an unfinished character."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if 0x80 <= lead <= 0xBF:
                continue
            size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            low, high = self.NARROW.get(lead, (0x80, 0xBF))
            return back if size > back and (back == 1 or low <= data[1 - back] <= high) else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.pending(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        """What a cut-off character at the end becomes."""
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")
