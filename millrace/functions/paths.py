"""Path text as columns: names, suffixes, mirrored output paths, stable source keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings and beginnings of files that are still being written.
TEMPORARY_SUFFIXES = (".tmp", ".temp", ".part", ".partial", ".crdownload", ".download", ".swp")
TEMPORARY_PREFIXES = (".", "~$", "._")

# A suffix starts at the last dot of a name that does not begin with that dot.
_SUFFIX = r"(?<=[^/])\.[^./]+$"


def normalised_extensions(extensions) -> tuple[str, ...]:
    """Lower-case extensions with a leading dot."""
    if isinstance(extensions, str):
        extensions = (extensions,)
    cleaned = [str(item).strip().lower() for item in extensions]
    if not all(cleaned):
        raise ValueError("An extension must not be empty.")
    return tuple(item if item.startswith(".") else f".{item}" for item in cleaned)


def file_name(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def file_suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), _SUFFIX, 0)


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, _SUFFIX, "")


def parent_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def is_temporary_file(path: Column) -> Column:
    """Whether a file name looks like a lock, temporary or partly downloaded file."""
    name = F.lower(file_name(path))
    checks = [name.startswith(prefix) for prefix in TEMPORARY_PREFIXES]
    checks += [name.endswith(suffix) for suffix in TEMPORARY_SUFFIXES]
    checks.append(name.endswith("~"))
    found = checks[0]
    for check in checks[1:]:
        found = found | check
    return found


def source_label(path: Column) -> Column:
    """The last path component, or ``-`` where there is no path."""
    return F.when(path.isNull() | path.isin("", "None"), F.lit("-")).otherwise(file_name(path))


def source_key(relative_path: Column) -> Column:
    """Stable key of one source file: SHA-1 of its path below the watched root."""
    return F.sha1(relative_path)


def _joined(*parts: Column) -> Column:
    text = F.concat_ws("/", *[F.when(part != "", part) for part in parts])
    return text


class MirrorPaths:
    """Output paths derived from source paths relative to a watched root.

    All methods return columns, so one job names the outputs of every source at once.
    """

    def __init__(self, root: str, relative_path: Column) -> None:
        self.root = F.lit(str(root).rstrip("/"))
        self.relative_path = relative_path

    @staticmethod
    def _relative(name: str) -> Column:
        text = str(name)
        if text.startswith("/"):
            raise ValueError("A derived file name must be relative.")
        if not text.strip():
            raise ValueError("A derived file name must not be empty.")
        return F.lit(text)

    def folder(self) -> Column:
        """The mirrored parent folder of each source."""
        return _joined(self.root, parent_folder(self.relative_path))

    def namespace(self) -> Column:
        """A folder of its own for each source, named after it."""
        return _joined(self.root, without_suffix(self.relative_path))

    def with_suffix(self, suffix: str) -> Column:
        """The source path below the mirror root with another suffix."""
        (ending,) = normalised_extensions(suffix)
        return F.concat(self.namespace(), F.lit(ending))

    def file(self, name: str) -> Column:
        """A file beside the mirrored source."""
        return _joined(self.folder(), self._relative(name))

    def namespaced_file(self, name: str) -> Column:
        """A file inside the folder of its source."""
        return _joined(self.namespace(), self._relative(name))

    def root_file(self, name: str) -> Column:
        """One stable file directly below the mirror root."""
        return _joined(self.root, self._relative(name))
