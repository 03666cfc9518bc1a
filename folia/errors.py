"""Errors of single-document calls. Bulk scans put their class and message in columns instead."""


class FoliaError(Exception):
    pass


class FileNotFound(FoliaError):
    pass


class FileData(FoliaError):
    """The bytes are no PDF."""


class PageNotFound(FoliaError):
    pass


class Malformed(FoliaError):
    """A part of the document can't be read."""


class DocumentClosed(FoliaError):
    pass


class Encrypted(FoliaError):
    """Encrypted in a way, or with a password, that can't be opened."""


class RenderingUnavailable(FoliaError):
    pass
