"""Replay files of a game as a Python data source: the base of the games' loaders.

Files are listed once, dealt into partitions of about ``bytes_each`` by size, and read where the tasks run, on any file system that the path
names. A file that can't be parsed fails the read, unless ``on_error`` is ``skip``: then it is left out."""

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))


class ReplaySource(DataSource):
    """A game derives from this and gives ``name()``, ``schema()`` and ``parse(path, content)``, which yields rows as tuples."""

    def parse(self, path: str, content: bytes) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return ReplayReader(self, dict(self.options))


class ReplayReader(DataSourceReader):
    def __init__(self, source: ReplaySource, options: dict):
        self.source, self.options = source, {k.lower(): v for k, v in options.items()}

    def _place(self):
        import pyarrow.fs

        path = self.options["path"]
        return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")

    def partitions(self) -> list[Files]:
        import pyarrow.fs

        fs, root = self._place()
        ending, most = self.options.get("extension", ""), int(self.options.get("bytes_each", 64 << 20))
        found = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(ending)]
        parts, own, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            if own and size + f.size > most:
                parts.append(Files(own))
                own, size = [], 0
            own.append(f.path)
            size += f.size
        return parts + ([Files(own)] if own else []) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = self._place()
        for path in partition.value:
            with fs.open_input_stream(path) as f:
                content = f.read()
            try:
                rows = list(self.source.parse(path, content))  # one replay
            except Exception:
                if self.options.get("on_error") != "skip":
                    raise
                continue
            yield from rows
