"""Flow files as a Spark data source: one partition per file, headers read where the file is read."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of text that a task parses at a time.
_BLOCK = 4 << 20


@dataclass
class FlowFile(InputPartition):
    """One file; what its name says holds for all of its rows."""

    uri: str
    state: str
    part: str
    year: int

    def __init__(self, uri: str, state: str, part: str, year: int):
        super().__init__(uri)
        self.uri, self.state, self.part, self.year = uri, state, part, year


def _listed(root: str, job_type: str) -> Iterator[FlowFile]:
    """All flow files below a folder, by one listing. A file's name may also be that of a folder with its pieces."""
    fs, base = pafs.FileSystem.from_uri(root)
    scheme = root.partition("://")[0] + "://" + root.partition("://")[2].partition("/")[0] if "://" in root and not root.startswith("file:") else ""
    name = re.compile(rf"([a-z]+)_od_([a-z]+)_{re.escape(job_type)}_(\d{{4}})\.csv")
    for found in fs.get_file_info(pafs.FileSelector(base, recursive=True)):
        told = name.search(found.path[len(base) :])
        if told and found.type == pafs.FileType.File and found.base_name[0] not in "._":
            path = found.path if found.path.startswith("/") or not scheme else f"/{found.path}"
            yield FlowFile(f"{scheme}{path}", told[1], told[2], int(told[3]))


class FlowReader(DataSourceReader):
    """Plans one task per chosen file; files that the options leave out are never opened."""

    def __init__(self, options: dict):
        self.root, self.segment, self.job_type = options["path"], options.get("segment", "S000"), options.get("jobtype", "JT00")
        self.chosen: dict[str, set] = {}
        for column, kind in (("state", str), ("part", str), ("year", int)):
            if column in options:
                self.chosen[column] = {kind(v) for v in options[column].split(",")}

    def partitions(self) -> Sequence[FlowFile]:
        files = list(_listed(self.root, self.job_type))
        if len(self.chosen) == 3:
            there = {(f.state, f.part, f.year) for f in files}
            wanted = set(product(*self.chosen.values()))
            if missing := sorted(wanted - there):
                raise FileNotFoundError(f"no flow file for {', '.join(map(str, missing[0]))} in {self.root}")
        return [f for f in files if all(getattr(f, c) in values for c, values in self.chosen.items())]

    def read(self, partition: FlowFile) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, FlowFile):  # no file was chosen
            return
        fs, path = pafs.FileSystem.from_uri(partition.uri)
        names = ["w_geocode", "h_geocode", self.segment]
        convert = pacsv.ConvertOptions(include_columns=names, column_types=dict.fromkeys(names, pa.string()), null_values=["", "NA"], strings_can_be_null=True)
        with fs.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as stream:
            try:
                batches = pacsv.open_csv(stream, pacsv.ReadOptions(block_size=_BLOCK), convert_options=convert)
            except KeyError as missing:
                raise ValueError(f"{missing.args[0]}: {partition.uri}") from None
            told = partition.state, partition.part, partition.year
            for batch in batches:
                constant = [pa.repeat(pa.scalar(v, pa.int32() if isinstance(v, int) else pa.string()), batch.num_rows) for v in told]
                yield pa.RecordBatch.from_arrays([*batch.columns, *constant], ["w_geocode", "h_geocode", "count", "state", "part", "year"])


class FlowSource(DataSource):
    """``spark.read.format("od_flows").load(root)``; options state, part, year (comma lists), jobtype, segment."""

    @classmethod
    def name(cls) -> str:
        return "od_flows"

    def schema(self) -> str:
        return "w_geocode string, h_geocode string, count string, state string, part string, year int"

    def reader(self, schema) -> DataSourceReader:
        return FlowReader(dict(self.options))
