"""Byte-pair encoding by backtracking, decoding by an offset table.

The library splits a text by the vocabulary's pattern.  A piece is then encoded from left to right with the longest
token that an Aho-Corasick automaton finds at each place.  Two neighbours are compatible if no merge across their
border would come before the merges that formed them; incompatible tokens are shortened to their next prefix token,
and if none is left the last token is taken back.  Ends that proved dead are marked, so every end is tried once and the
work is linear.  With compatible neighbours throughout, the tokens are those of applying the merges in rank order.

Null texts count as empty and have no ids; null ids decode to the empty text.  Repeated rows give the same ids, empty
tables an empty result, and other columns are carried (one named like an added column is replaced).  Texts of any
length are encoded whole: a text is cut where a blank follows a visible character, where the pattern always cuts.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.common import carrying, add_columns, pieces, table
from vocspark.llm.registry import query

# Fixed value: the pattern that this vocabulary splits texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Numbers of later Unicode versions, which the vocabulary's own library takes for symbols.
LATER_NUMBERS = "\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
CACHED_PIECES = 200_000
CACHED_LENGTH = 64
CACHED_PAIRS = 250_000
CUT_CHARACTERS = 1 << 20
_SAFE_CUT = re.compile(r"(?<=[0-9A-Za-z.,]) ")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Decoder:
    """The offset table: all tokens' bytes in one array, and where each begins."""

    def __init__(self, spec: dict):
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        all_ = [tokens.get(i, b"") for i in range(1 + max(tokens))]
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in all_]))).astype(np.int64)
        self.blob = np.frombuffer(b"".join(all_), dtype=np.uint8)

    def gather(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids."""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        shift = np.repeat(starts - (ends - sizes), sizes)
        return self.blob[shift + np.arange(len(shift), dtype=np.int64)]

    def texts(self, packed: list[bytes]) -> list[str]:
        """Texts of packed ids; bytes that are no UTF-8 become replacement characters."""
        out = []
        for first, last in pieces(packed):
            numbers = np.frombuffer(b"".join(packed[first:last]), dtype="<u4").astype(np.int64)
            places = np.concatenate(([0], np.cumsum(self.offsets[numbers + 1] - self.offsets[numbers])))
            raw = self.gather(numbers).tobytes()
            cuts = places[np.concatenate(([0], np.cumsum([len(v) // 4 for v in packed[first:last]])))].tolist()
            out += [raw[a:b].decode("utf-8", errors="replace") for a, b in zip(cuts[:-1], cuts[1:])]
        return out


class Vocabulary:
    """Tokens, merges and the tables for exact encoding."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.tokens: dict[int, bytes] = {
            i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        ids = {t: i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for number, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, made = (ids[left], ids[right]), ids[left + right]
            self.rank[pair] = number
            if made not in self.parts:
                self.parts[made], self.made_at[made] = pair, number
        self.length = {i: len(t) for i, t in self.tokens.items()}
        self._compatible: dict[int, bool] = {}
        self._lefts: dict[int, list] = {}
        self._rights: dict[int, list] = {}
        # A node's branches are searched in the order in which they came, so frequent tokens come first.
        usable = [i for i in sorted(self.tokens, key=lambda i: self.made_at.get(i, 1 << 40)) if self._forms(i)]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        by_bytes = {self.tokens[i]: i for i in usable}
        self.shorter: dict[int, int] = {}
        for i in usable:
            token = self.tokens[i]
            self.automaton.add_word(token.decode("latin-1"), i)
            self.shorter[i] = next((by_bytes[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in by_bytes), -1)
        self.automaton.make_automaton()
        self._split_all = regex.compile(PATTERN).findall
        self._later = re.compile(f"[{LATER_NUMBERS}]").search
        numbers = rf"[\p{{N}}--[{LATER_NUMBERS}]]"
        self._split_later = regex.compile(
            "(?V1)" + PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s\p{{L}}{numbers}]").replace(r"?\p{N}", "?" + numbers)).findall
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._cache = _Cache(self)

    def _spine(self, token: int, side: int, limit: float) -> list[tuple[int, float]]:
        """Tokens along one edge of a token's merge tree, each with the rank at which it is absorbed."""
        out = []
        while True:
            out.append((token, limit))
            if token not in self.parts:
                return out
            limit, token = self.made_at[token], self.parts[token][side]

    def _clash(self, left: int, right: int, limit: float) -> bool:
        """Would a merge across the border come first?  Of equal ranks the left one goes first."""
        rank = self.rank
        for x, until_x in self._spine(left, 1, limit):
            for y, until_y in self._spine(right, 0, limit):
                merge = rank.get((x, y))
                if merge is not None and merge < until_x and merge <= until_y and merge < limit:
                    return True
        return False

    def _forms(self, token: int) -> bool:
        """Do the merges really lead to this token from its bytes?"""
        return token not in self.parts or not self._clash(*self.parts[token], self.made_at[token])

    def compatible(self, left: int, right: int) -> bool:
        """One entry of the pair table, found on first use; the table is only a cache and emptied when full."""
        known = self._compatible.get(left << 32 | right)
        if known is not None:
            return known
        if len(self._compatible) > CACHED_PAIRS:
            self._compatible.clear()
        rights = self._rights.get(right)
        if rights is None:
            rights = self._rights[right] = self._spine(right, 0, float("inf"))
        lefts = self._lefts.get(left)
        if lefts is None:
            lefts = self._lefts[left] = self._spine(left, 1, float("inf"))
        rank, known = self.rank, True
        for x, until_x in lefts:
            for y, until_y in rights:
                merge = rank.get((x, y))
                if merge is not None and merge < until_x and merge <= until_y:
                    known = False
                    break
        self._compatible[left << 32 | right] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Exact merges of one piece, by longest matches and backtracking."""
        n, length, shorter = len(piece), self.length, self.shorter
        longest = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length[token] + 1] = token
        alive, out, at = bytearray(b"\x01") * (n + 1), [], 0
        token = longest[0] if n else -1
        while at < n:
            while token >= 0 and not (alive[at + length[token]] and (not out or self.compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def _split(self, text: str) -> list[str]:
        return self._split_later(text) if not text.isascii() and self._later(text) else self._split_all(text)

    def _plain(self, text: str, out: list[bytes]) -> None:
        start = 0
        while len(text) - start > 2 * CUT_CHARACTERS:
            cut = _SAFE_CUT.search(text, start + CUT_CHARACTERS)
            if cut is None:
                break
            out.append(b"".join(map(self._cache.__getitem__, self._split(text[start:cut.start()]))))
            start = cut.start()
        out.append(b"".join(map(self._cache.__getitem__, self._split(text[start:] if start else text))))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        if self._special is None or not any(s in text for s in self.special):
            self._plain(text, out)
        else:
            for part in self._special.split(text):
                if part in self.special:
                    out.append(self.special[part].to_bytes(4, "little"))
                else:
                    self._plain(part, out)
        return b"".join(out)


class _Cache(dict):
    """Packed ids of pieces; only a cache, emptied when full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.encode_piece(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    with open(path, encoding="utf-8") as file:
        return Decoder(json.load(file))


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the token ids of the whole text as little-endian unsigned 32-bit integers.

    ``path`` must exist on the executors; null is the installed public vocabulary.
    """
    def work(texts):
        encode = vocabulary(path or default_path()).encode
        return [[encode(t) if t else b"" for t in texts.to_pylist()]]

    return add_columns(docs, [text], "ids binary", work)


def decode_documents(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of packed ids; bytes that are no UTF-8 become replacement characters."""
    def work(packed):
        return [pa.array(decoder(path or default_path()).texts([x or b"" for x in packed.to_pylist()]), pa.string())]

    return add_columns(rows, [ids], "decoded string", work)


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, both in one pass over the texts."""
    def work(texts):
        where = path or default_path()
        encode = vocabulary(where).encode
        packed = [encode(t) if t else b"" for t in texts.to_pylist()]
        return [packed, pa.array(decoder(where).texts(packed), pa.string())]

    return add_columns(docs, [text], "ids binary, decoded string", work)


def digests(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode, decode, and reduce both to digests; the ids stay if asked for."""
    coded = round_trip(docs, path).drop("text")
    return coded.withColumns({
        "n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256),
        "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)}).drop("decoded", *(["ids"] if not keep_ids else []))


@carrying
def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Last pipeline stage: the documents with their packed ids and digests of ids and decoded texts, other columns carried."""
    return digests(docs, keep_ids=True)


@query("op3_bpe_round_trip")
def bpe_round_trip(spark, folder):
    return digests(table(spark, folder, "documents").select("doc_id", "text"))
