"""BPE encoding and decoding by tree concatenation, exact to the ``tokenizers`` library.

Short texts are encoded whole. A long text is normalised once, cut into pieces of at most
``piece_chars`` characters that different tasks encode in parallel, and joined again: around each join
a growing window of pre-tokens is scanned anew until its first and last pre-token agree with what the
two sides had. A run without any split point (one giant pre-token) is joined the same way one level
down: halves are encoded apart and a growing window of tokens around the join is encoded again until
its first token equals the left side's and its last token the right side's. Two neighbouring tokens
that BPE leaves alone in one encoding are left alone in every other, so agreement at both ends makes
the joined sequence the exact encoding.

Defined results: a null or empty text has no tokens and decodes to the empty text; repeated rows each
give a row; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 1 << 16
#: Pre-tokens above this many byte-level symbols are encoded as a tree of halves.
LEAF = 64
#: Distinct white-space-free chunks whose encodings a worker keeps.
CACHE = 200_000

#: Texts over this alphabet are their own NFC form, and lower-casing and classes are plain there.
SIMPLE = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
SIMPLE_PRETOKEN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r a-zß-öø-ÿ0-9]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class TreeBpe:
    """A vocabulary file of the ``tokenizers`` library with encodings that can be joined."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.end = self.library.model
        self.mid = BPE(model["vocab"], merges)
        self.token = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else re.compile(r"(?!)")
        self.pretoken_re = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = byte_symbols()
        self.cache = _Chunks(self)

    # one pre-token, as byte-level symbols

    def _run(self, s: str, last: bool) -> list[int]:
        return [t.id for t in (self.end if last else self.mid).tokenize(s)]

    def tree(self, s: str, last: bool = True) -> list[int]:
        if len(s) <= LEAF:
            return self._run(s, last)
        half = len(s) // 2
        return self.join(self.tree(s[:half], False), self.tree(s[half:], last), last)

    def _text(self, ids: list[int]) -> str:
        return "".join(self.token[i].removesuffix(self.suffix) if self.suffix else self.token[i] for i in ids)

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Encode again a growing window around the join until both sides agree."""
        k = 2
        while True:
            a, b = left[-k:], right[:k]
            ends = last and k >= len(right)
            new = self._run(self._text(a) + self._text(b), ends)
            if (k >= len(left) or new[0] == a[0]) and (k >= len(right) or new[-1] == b[-1]):
                return left[: max(0, len(left) - k)] + new + right[k:]
            k *= 2

    def pretoken(self, word: str, last: bool = True) -> list[int]:
        return self.tree("".join(self.symbols[b] for b in word.encode()), last)

    # whole texts

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        out: list = []
        odd: list[int] = []
        get = self.cache.__getitem__
        for i, text in enumerate(texts):
            if SIMPLE.fullmatch(text) and "<|" not in text:
                found = [*map(get, text.lower().split())]
                out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found])))
            else:
                out.append(None)
                odd.append(i)
        if odd:
            for i, e in zip(odd, self.library.encode_batch([texts[i] for i in odd], add_special_tokens=False), strict=True):
                out[i] = packed(e.ids), self.decode(e.ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids, skip_special_tokens=False)

    # pieces of a long text

    def segments(self, text: str) -> list[tuple[str, int]]:
        """Normalised stretches between special tokens, each with the special id that follows it or -1."""
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out.append((text[at : m.start()], self.special[m[0]]))
            at = m.end()
        out.append((text[at:], -1))
        return [(self.library.normalizer.normalize_str(s) if s else "", sep) for s, sep in out]

    def piece(self, text: str, final: bool) -> list[tuple[int, int, list[int]]]:
        """(start, end, ids) of each pre-token; one that reaches a cut is encoded as if its word went on."""
        return [(m.start(), m.end(), self.pretoken(m[0], final or m.end() < len(text))) for m in self.pretoken_re.finditer(text)]

    def join_pieces(self, text: str, left: list, right: list, cut: int, final: bool) -> list:
        """Spans of two neighbouring pieces, with offsets into ``text``; ``right`` ends at the end of ``text``."""
        known = {(a, b): ids for a, b, ids in left + right}
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            start = a[0][0] if k <= len(left) else 0
            stop = b[-1][1] if k <= len(right) else len(text)
            spans = [m.span() for m in self.pretoken_re.finditer(text, start, stop)]
            if (k > len(left) or spans[:1] == [a[0][:2]] and len(left) - k >= 0 and a[0][1] < cut) and (k > len(right) or spans[-1:] == [b[-1][:2]] and b[-1][0] > cut):
                break
            k *= 2
        new = []
        for s, e in spans:
            goes_on = e == len(text) and not final
            if left and right and (s, e) == (left[-1][0], right[0][1]) and left[-1][1] == right[0][0] == cut:
                ids = self.join(left[-1][2], right[0][2], not goes_on)
            elif (s, e) in known and e != cut:
                ids = known[s, e]
            elif (s, e) in known and left and left[-1][:2] == (s, e):
                ids = self.join(known[s, e], [], True)
            else:
                ids = self.pretoken(text[s:e], not goes_on)
            new.append((s, e, ids))
        return left[: max(0, len(left) - k)] + new + right[k:]

    def join_all(self, pieces: list[tuple[str, list]]) -> list[int]:
        """Join the pieces of one stretch pairwise, as a tree."""
        level = [(t, spans, i == len(pieces) - 1) for i, (t, spans) in enumerate(pieces)]
        while len(level) > 1:
            up = []
            for i in range(0, len(level) - 1, 2):
                (t, a, _), (u, b, final) = level[i], level[i + 1]
                up.append((t + u, self.join_pieces(t + u, a, [(s + len(t), e + len(t), ids) for s, e, ids in b], len(t), final), final))
            level = up + level[len(level) - len(level) % 2 :]
        return [i for _, _, ids in level[0][1] for i in ids]


class _Chunks(dict):
    """White-space-free lower-case chunk over the simple alphabet -> (ids, decoded)."""

    def __init__(self, bpe: TreeBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        ids = [i for w in SIMPLE_PRETOKEN.findall(chunk) for i in self.bpe.pretoken(w)]
        found = packed(ids), " ".join([self.bpe.token[i] for i in ids])
        if len(chunk) <= LEAF:
            self[chunk] = found
        return found


def packed(ids: list[int]) -> bytes:
    import numpy as np

    return np.asarray(ids, "<u4").tobytes()


_LOADED: dict[str, TreeBpe] = {}


def loaded(path: str) -> TreeBpe:
    if path not in _LOADED:
        _LOADED[path] = TreeBpe(path)
    return _LOADED[path]


OUT = "id {id}, ids binary, decoded string"


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(id, ids, decoded): token ids as little-endian unsigned 32-bit integers, and the text that they decode to."""
    path = path or default_path()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    ids_type = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(ids_type)
    out_schema = pa.schema([("id", id_arrow), ("ids", pa.binary()), ("decoded", pa.string())])
    piece_schema = pa.schema([("id", id_arrow), ("whole", pa.binary()), ("seg", pa.int32()), ("part", pa.int32()), ("parts", pa.int32()), ("sep", pa.int32()), ("piece", pa.string())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                found = bpe.encode(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], schema=out_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                mark = hashlib.sha256(text.encode()).digest()
                rows = []
                for seg, (s, sep) in enumerate(bpe.segments(text)):
                    pieces = [s[i : i + piece_chars] for i in range(0, len(s), piece_chars)] or [""]
                    rows += [{"id": key, "whole": mark, "seg": seg, "part": i, "parts": len(pieces), "sep": sep, "piece": p} for i, p in enumerate(pieces)]
                yield pa.RecordBatch.from_pylist(rows, schema=piece_schema)

    spans_schema = piece_schema.append(pa.field("spans", pa.binary()))

    def encode_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        bpe = loaded(path)
        for batch in batches:
            spans = [pickle.dumps(bpe.piece(p, i == n - 1)) for p, i, n in zip(batch.column("piece").to_pylist(), batch.column("part").to_pylist(), batch.column("parts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.binary())], schema=spans_schema)

    def gather(table: pa.Table) -> pa.Table:
        import pickle

        bpe = loaded(path)
        parts: dict = {}
        copies: dict = {}
        for r in table.to_pylist():
            parts[r["seg"], r["part"]] = r
            copies[r["seg"], r["part"]] = copies.get((r["seg"], r["part"]), 0) + 1
        ids: list[int] = []
        for seg in sorted({s for s, _ in parts}):
            own = [parts[k] for k in sorted(parts) if k[0] == seg]
            ids += bpe.join_all([(r["piece"], pickle.loads(r["spans"])) for r in own])
            if own[0]["sep"] >= 0:
                ids.append(own[0]["sep"])
        n = copies[0, 0]  # equal rows have equal pieces
        return pa.Table.from_arrays([pa.array([r["id"]] * n, id_arrow), pa.array([packed(ids)] * n, pa.binary()), pa.array([bpe.decode(ids)] * n, pa.string())], schema=out_schema)

    long = F.length("text") > piece_chars
    short_rows = rows.filter(~long).mapInArrow(whole, OUT.format(id=kind))
    shape = f"id {kind}, whole binary, seg int, part int, parts int, sep int, piece string"
    pieces = rows.filter(long).mapInArrow(cut, shape).repartition(F.col("whole"), F.col("seg"), F.col("part")).mapInArrow(encode_piece, shape + ", spans binary")
    return short_rows.unionByName(pieces.groupBy("id", "whole").applyInArrow(gather, OUT.format(id=kind)))


def decode_ids(rows: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, decoded): the text that stored ids decode to; null ids decode to the empty text."""
    path = path or default_path()
    rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(rows.schema["id"].dataType)), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = loaded(path)
        for batch in batches:
            text = [bpe.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(text, pa.string())], schema=schema)

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, decoded string")


def digest(docs: DataFrame, path: str | None = None, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Per document the token count and the SHA-256 of ids and decoded text."""
    done = encode_decode(docs, path=path, piece_chars=piece_chars)
    return done.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
