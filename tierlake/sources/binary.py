"""The binary corpus format: a header with the catalog in CBOR, then documents as packed vectors layer by layer.

Texts are written as they are; files whose texts are compressed by other codecs are refused, as their code tables aren't
part of the format. Texts of more than 65,535 bytes and links or places of 2^31 and more can't be written.
"""

from __future__ import annotations

import io
import struct
from collections import OrderedDict
from collections.abc import Iterator
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.document import Document
from tierlake.errors import FormatError
from tierlake.meta import Catalog, LayerType
from tierlake.sources import cbor, ingest
from tierlake.sources.spool import Spool, batches, written

# The six bytes that a file starts with, version, byte of a missing layer, and most strings that await their second sight.
MAGIC, VERSION, MISSING, SEEN_ONCE = b"TEANGA", 1, 0xFF, 1_000_000
# The first tag of each shape, by how many numbers a unit has and whether it has a text.
TAGS = {(1, False): 1, (2, False): 3, (3, False): 7, (0, True): 11, (1, True): 12, (2, True): 14, (3, True): 18}


class Dictionary:
    """Strings that got a number when they were seen a second time; both sides keep it alike."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.strings: list[str] = []
        self._once: OrderedDict[str, None] = OrderedDict()

    def meet(self, text: str) -> int | None:
        """The number of a string, or None if it has to be spelt out."""
        if text in self.numbers:
            return self.numbers[text]
        if text in self._once:
            del self._once[text]
            self.numbers[text] = len(self.strings)
            self.strings.append(text)
        else:
            self._once[text] = None
            if len(self._once) > SEEN_ONCE:
                self._once.popitem(last=False)
        return None


def pack_numbers(values: list[int]) -> bytes:
    """A vector of numbers: bits each, count, and the bits, highest first."""
    most = max(values, default=0)
    if most >= 1 << 31:
        raise FormatError(f"{most} is too large")
    bits = most.bit_length()
    bits += bits in (16, 24)  # widths that readers of the format mistake
    head = struct.pack(">BI", bits, len(values))
    if not bits:
        return head
    table = (np.array(values, np.int64)[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    return head + np.packbits(table.astype(np.uint8).reshape(-1)).tobytes()


def varint(n: int) -> bytes:
    """Seven bits a byte, highest first, the top bit set but for the last."""
    if n >= 1 << 28:
        raise FormatError(f"{n} is too large")
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


class Reader:
    """Reads the parts of a file in turn."""

    def __init__(self, source: BinaryIO):
        self._source = source

    def take(self, n: int) -> bytes:
        got = self._source.read(n)
        if len(got) != n:
            raise FormatError("the file ends within a document")
        return got

    def more(self) -> int | None:
        got = self._source.read(1)
        return got[0] if got else None

    def vector(self) -> bytes:
        """A vector of numbers as it stands."""
        head = self.take(5)
        bits, n = struct.unpack(">BI", head)
        return head + self.take((bits * n + 7) // 8)

    def numbers(self) -> list[int]:
        bits, n = struct.unpack(">BI", self.take(5))
        raw = np.frombuffer(self.take((bits * n + 7) // 8), np.uint8)
        if not bits:
            return [0] * n
        table = np.unpackbits(raw)[: bits * n].reshape(n, bits).astype(np.int64)
        return (table << np.arange(bits - 1, -1, -1)).sum(1).tolist()

    def varint(self) -> int:
        n = 0
        while True:
            b = self.take(1)[0]
            n = n << 7 | b & 127
            if b < 128:
                return n

    def strings(self, words: Dictionary) -> list[str]:
        n = self.varint()
        spelt = np.unpackbits(np.frombuffer(self.take((n + 7) // 8), np.uint8))[:n]
        out = []
        for s in spelt:
            if s:
                out.append(self.take(self.varint()).decode())
                words.meet(out[-1])
            else:
                out.append(words.strings[self.varint()])
        return out


def pack_strings(values: list[str], words: Dictionary) -> bytes:
    """A vector of strings: count, which of them are spelt out, and texts with their length or numbers."""
    spelt, body = [], []
    for v in values:
        number = words.meet(v)
        spelt.append(number is None)
        raw = v.encode()
        body.append(varint(len(raw)) + raw if number is None else varint(number))
    return varint(len(values)) + np.packbits(np.array(spelt, np.uint8)).tobytes() + b"".join(body)


def spell(values: list[str]) -> bytes:
    """A vector of strings that are all spelt out, which reads the same after any strings."""
    raw = [v.encode() for v in values]
    return varint(len(raw)) + np.packbits(np.ones(len(raw), np.uint8)).tobytes() + b"".join(varint(len(r)) + r for r in raw)


def layer_parts(desc: Any, value: Any) -> tuple[bytes, list[str] | None]:
    """One layer of a document: what needs no other document, and the strings that follow it, if any."""
    if desc.layer_type is LayerType.characters:
        raw = value.encode()
        if len(raw) > 0xFFFF:
            raise FormatError(f"a text of {len(raw)} bytes is too long for the format")
        return b"\0" + struct.pack(">H", len(raw)) + raw, None
    shapes = {v[0] for _, _, v in value}
    if len(shapes) > 1 or (shapes == {0} and desc.layer_type is LayerType.seq):
        raise FormatError("the values of a layer are of one kind in the format")
    rank = shapes.pop() if shapes else 0
    columns = {LayerType.seq: [], LayerType.span: [[u[0] for u in value], [u[1] for u in value]]}.get(desc.layer_type, [[u[0] for u in value]])
    if rank >= 2:
        columns.append([u[2][1] for u in value])
    has_text = rank in (1, 3)
    if not value:
        columns, has_text = [[]], False  # an empty layer is an empty vector of places
    tag, n = TAGS[len(columns), has_text], len(columns)
    rises = n > 0 and all(a < b for a, b in zip(columns[0], columns[0][1:]))
    follows = n > 1 and all(a <= b for a, b in zip(columns[0], columns[1]))
    if n > 1:
        tag += (0 if follows else 1) if rises else (2 if follows else 3)
        if follows:
            columns[1] = [b - a for a, b in zip(columns[0], columns[1])]
    elif n == 1:
        tag += 0 if rises else 1
    if rises:
        columns[0] = [b - a for a, b in zip([0, *columns[0]], columns[0])]
    out = bytes([tag]) + b"".join(map(pack_numbers, columns))
    if has_text:
        texts = [u[2][2] for u in value]
        if isinstance(desc.data, tuple):
            if set(texts) - set(desc.data):
                raise FormatError(f"{sorted(set(texts) - set(desc.data))[0]!r} isn't among the values of its layer")
            out += pack_numbers([desc.data.index(t) for t in texts])
        else:
            return out, texts
    return out, None


def pack_layer(desc: Any, value: Any, words: Dictionary) -> bytes:
    """One layer of a document."""
    out, texts = layer_parts(desc, value)
    return out if texts is None else out + pack_strings(texts, words)


def document_parts(doc: Document) -> tuple[list[bytes], list[list[str]]]:
    """One document as bytes and the vectors of strings between them, one less."""
    raw, strings = [b""], []
    for name in sorted(doc.catalog):
        out, texts = layer_parts(doc.catalog[name], doc[name]) if name in doc else (bytes([MISSING]), None)
        raw[-1] += out
        if texts is not None:
            strings.append(texts)
            raw.append(b"")
    return raw, strings


def _shape(tag: int) -> tuple[int, bool, int]:
    """How many numbers a unit has, whether it has a text, and how the vectors are packed."""
    for (n, has_text), first in TAGS.items():
        if first <= tag < first + (4 if n > 1 else 2 if n == 1 else 1):
            return n, has_text, tag - first
    raise FormatError(f"no layer begins with byte {tag}")


def take_layer(tag: int, desc: Any, reader: Reader, words: Dictionary) -> Any:
    """The wire form of one layer."""
    if tag == 0:
        return reader.take(struct.unpack(">H", reader.take(2))[0]).decode()
    if tag == 22:
        return cbor.loads(reader.take(struct.unpack(">I", reader.take(4))[0]))
    n, has_text, mode = _shape(tag)
    rises, follows = (mode < 2, mode % 2 == 0) if n > 1 else (n == 1 and mode == 0, False)
    columns = [reader.numbers() for _ in range(n)]
    if rises:
        columns[0] = np.cumsum(columns[0]).tolist()
    if follows:
        columns[1] = [a + b for a, b in zip(columns[0], columns[1])]
    if has_text:
        columns.append([desc.data[i] for i in reader.numbers()] if isinstance(desc.data, tuple) else reader.strings(words))
    return list(columns[0]) if len(columns) == 1 else [list(x) for x in zip(*columns)]


def skim_layer(tag: int, desc: Any, reader: Reader, words: Dictionary) -> bytes:
    """One layer as it stands, but for strings, which are spelt out."""
    if tag in (0, 22):
        size = reader.take(2 if tag == 0 else 4)
        return bytes([tag]) + size + reader.take(int.from_bytes(size))
    n, has_text, _ = _shape(tag)
    out = bytes([tag]) + b"".join([reader.vector() for _ in range(n)])
    if has_text:
        out += reader.vector() if isinstance(desc.data, tuple) else spell(reader.strings(words))
    return out


def dumps(doc: Document, words: Dictionary | None = None) -> bytes:
    """One document; ``words`` are the strings of the documents before it, none by default."""
    words = Dictionary() if words is None else words
    return b"".join(pack_layer(doc.catalog[name], doc[name], words) if name in doc else bytes([MISSING]) for name in sorted(doc.catalog))


def _tags(reader: Reader, catalog: Catalog) -> Iterator[tuple[str, int]]:
    """The layers of the next document with their first bytes; none at the end. The caller reads each layer before the next."""
    for i, name in enumerate(sorted(catalog)):
        tag = reader.more()
        if tag is None:
            if i:
                raise FormatError("the file ends within a document")
            return
        yield name, tag


def take_document(reader: Reader, catalog: Catalog, words: Dictionary) -> dict[str, Any] | None:
    """The wire form of the next document, or None at the end."""
    content: dict[str, Any] | None = None
    for name, tag in _tags(reader, catalog):
        content = content or {}
        if tag != MISSING:
            content[name] = take_layer(tag, catalog[name], reader, words)
    return content


def skim_document(reader: Reader, catalog: Catalog, words: Dictionary) -> bytes:
    """The next document as one that can be read by itself, nothing at the end."""
    return b"".join([bytes([tag]) if tag == MISSING else skim_layer(tag, catalog[name], reader, words) for name, tag in _tags(reader, catalog)])


def loads(raw: bytes, catalog: Catalog, words: Dictionary | None = None) -> Document:
    """The document that ``dumps`` wrote."""
    content = take_document(Reader(io.BytesIO(raw)), catalog, Dictionary() if words is None else words)
    if content is None:
        raise FormatError("no document")
    return Document(catalog, content)


def write_header(catalog: Catalog, out: BinaryIO) -> None:
    meta = cbor.dumps(catalog.to_dict())
    out.write(MAGIC + struct.pack(">HI", VERSION, len(meta)) + meta + b"\0")


def write(docs: Iterator[Document], catalog: Catalog, out: BinaryIO) -> None:
    """A corpus to an open file, document by document."""
    write_header(catalog, out)
    words = Dictionary()
    for doc in docs:
        out.write(dumps(doc, words))


def read_header(reader: Reader) -> Catalog:
    """The catalog of an open file, whose documents follow."""
    if reader.take(6) != MAGIC:
        raise FormatError("no corpus in the binary format")
    version, size = struct.unpack(">HI", reader.take(6))
    if version > VERSION:
        raise FormatError(f"version {version} is later than {VERSION}")
    catalog = Catalog.from_dict(cbor.loads(reader.take(size)))
    if (codec := reader.take(1)[0]) != 0:
        raise FormatError(f"texts are compressed by codec {codec}, which isn't supported")
    return catalog


def read(source: BinaryIO) -> tuple[Catalog, Iterator[dict[str, Any]]]:
    """The catalog of an open file and the wire forms of its documents, read as they are asked for."""
    reader = Reader(source)
    catalog = read_header(reader)

    def documents() -> Iterator[dict[str, Any]]:
        words = Dictionary()
        while (content := take_document(reader, catalog, words)) is not None:
            yield content

    return catalog, documents()


def write_file(docs: DataFrame, catalog: Catalog, path: str) -> None:
    """All documents in order; layers whose names start with ``_`` aren't part of the format.

    Executors pack them; the driver puts in the strings, whose numbers follow from all before, and puts all together.
    """
    names = list(catalog)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ingest.BATCH):
                out: list[tuple] = []
                for row in batch.slice(lo, ingest.BATCH).to_pylist():
                    try:
                        out.append((*document_parts(ingest.document_of(row, catalog)), None))
                    except FormatError as e:
                        out.append((None, None, str(e)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.list_(pa.binary()), pa.list_(pa.list_(pa.string())), pa.string()))], ["raw", "strings", "wrong"])

    rows = docs.orderBy("doc_pos").select("doc_id", "doc_pos", *[f"`{n}`" for n in names], "_extra").mapInArrow(run, "raw array<binary>, strings array<array<string>>, wrong string")
    words = Dictionary()
    with open(path, "wb") as out, written(rows) as parts:
        write_header(catalog, out)
        for part in parts:
            for batch in batches(part):
                for raw, strings, wrong in zip(*(c.to_pylist() for c in batch.columns)):
                    if wrong is not None:
                        raise FormatError(wrong)
                    out.write(raw[0] + b"".join(pack_strings(t, words) + r for t, r in zip(strings, raw[1:])))


def read_file(spark: SparkSession, path: str) -> tuple[Catalog, DataFrame]:
    """The corpus of a file. It can't be split, since strings refer to earlier ones: the driver reads it through, spells these out and hands
    the documents on through the shared folder; executors decode them."""
    from tierlake.sources.files import with_ids

    spool, words, n = Spool(spark, pa.schema([("doc_pos", pa.int64()), ("raw", pa.binary())])), Dictionary(), 0
    with open(path, "rb") as source:
        reader = Reader(source)
        catalog = read_header(reader)
        while raw := skim_document(reader, catalog, words):
            spool.add(n, raw)
            n += 1
    columns = ingest.arrow_schema(catalog)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ingest.BATCH):
                pairs = zip(*(c.to_pylist() for c in batch.slice(lo, ingest.BATCH).columns))
                yield pa.RecordBatch.from_pylist([ingest.row_of(loads(raw, catalog), None, pos) for pos, raw in pairs], columns)

    made = with_ids(spool.frame().select("doc_pos", "raw").mapInArrow(run, ingest.schema(catalog)), catalog, check=False)
    spool.drop()
    return catalog, made.select("doc_id", "doc_pos", *[F.col(f"`{c}`") for c in catalog], "_extra")
