"""A channel of documents: a sender that declares layers and adds documents, a receiver that waits for the catalog and takes them."""

from __future__ import annotations

import queue
import threading
from collections.abc import Iterator, Mapping
from typing import Any

from tierlake.document import Document
from tierlake.errors import TierlakeError
from tierlake.meta import Catalog
from tierlake.operators import ids

_END = object()


class ChannelClosed(TierlakeError):
    """The sender ended before it said what the layers are."""


class Sender:
    """The writing end; bounded, so a fast sender waits for the receiver."""

    def __init__(self, catalog_box: queue.Queue, docs: queue.Queue):
        self._box, self._docs = catalog_box, docs
        self._catalog: Catalog | None = None
        self._taken: set[str] = set()

    def set_meta(self, catalog: Catalog) -> None:
        self._catalog = catalog
        self._box.put(catalog)

    def add_doc(self, content: Mapping[str, Any]) -> str:
        if self._catalog is None:
            raise TierlakeError("set_meta comes before add_doc")
        doc = Document(self._catalog, content)
        doc_id = ids.shortest_free(ids.code_of(doc, self._catalog), self._taken)
        self._taken.add(doc_id)
        self._docs.put((doc_id, doc))
        return doc_id

    def close(self) -> None:
        if self._catalog is None:
            self._box.put(_END)
        self._docs.put(_END)


class Receiver:
    """The reading end: documents in order until the sender closes."""

    def __init__(self, catalog: Catalog, docs: queue.Queue):
        self.catalog, self._docs = catalog, docs

    def __iter__(self) -> Iterator[tuple[str, Document]]:
        while (item := self._docs.get()) is not _END:
            yield item


class Waiting:
    """A reading end whose catalog isn't there yet."""

    def __init__(self, catalog_box: queue.Queue, docs: queue.Queue):
        self._box, self._docs = catalog_box, docs

    def await_meta(self, timeout: float | None = None) -> Receiver:
        got = self._box.get(timeout=timeout)
        if got is _END:
            raise ChannelClosed("closed without a catalog")
        return Receiver(got, self._docs)


def channel(held: int = 1000) -> tuple[Sender, Waiting]:
    """Both ends of a channel that holds at most ``held`` documents."""
    box, docs = queue.Queue(1), queue.Queue(held)
    return Sender(box, docs), Waiting(box, docs)


def pipe(produce, consume, held: int = 1000) -> Any:
    """Runs ``produce(sender)`` in a thread and ``consume(receiver)`` here; its result. An error of either end is raised."""
    sender, waiting = channel(held)
    failed: list[BaseException] = []

    def run() -> None:
        try:
            produce(sender)
        except BaseException as e:  # noqa: BLE001
            failed.append(e)
        finally:
            sender.close()

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        result = consume(waiting.await_meta())
    except ChannelClosed:
        if failed:
            raise failed[0] from None
        raise
    thread.join()
    if failed:
        raise failed[0]
    return result
