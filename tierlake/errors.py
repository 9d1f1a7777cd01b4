"""The errors that the engine raises; nothing crashes on wrong input."""


class TierlakeError(Exception):
    """Any error of the engine."""


class ModelError(TierlakeError):
    """An undeclared layer, or a value whose shape doesn't fit its layer's type."""


class DocumentNotFoundError(TierlakeError):
    """No document has the id."""


class LayerNotFoundError(TierlakeError):
    """A layer isn't declared, or a document lacks it where it is needed."""


class IndexingError(TierlakeError):
    """The target can't be reached from the layer, or an index is out of bounds."""


class FormatError(TierlakeError, ValueError):
    """A file that can't be read or written in its format, or whose ids don't fit its content."""
