"""NetCDF files, classic (CDF-1 and CDF-2) and of the HDF5-based format, as a Spark
data source, and a sink that writes classic ones.

`spark.read.format("netcdf").load(path)` gives one row for each cell of the
variables that share the full set of dimensions: a column for each dimension
(its coordinate values) and each variable.  A dimension whose coordinate has CF
units ("days since ...") becomes a timestamp; one without stays a number.  A
partition is a range of the first dimension, so that a file is read in pieces: from a
chunked file, of whole chunks.  With `read_netcdf(spark, path, variables)` only those
variables are read, and a filter on the first dimension leaves out the partitions
that cannot meet it (where spark.sql.python.filterPushdown.enabled is set, as
`fluxpanel.session` does).

`write_raster` writes a table back: tasks write slices to files of their own attempt,
which are joined when all are done.  Paths are local or mounted everywhere, as the
formats need random access."""

from __future__ import annotations

import json
import shutil
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import hdf5
from .readers import ALIASES, cf_time

#: Fixed values of the format: type codes, and the tags of its lists.
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_CODES = {"i1": 1, "i2": 3, "i4": 4, "f4": 5, "f8": 6}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    dtype: np.dtype
    begin: int
    record: bool = False


@dataclass
class Header:
    """Dimensions (name, size; 0 is the record dimension), variables, attributes."""

    dims: list[tuple[str, int]] = field(default_factory=list)
    variables: dict[str, Variable] = field(default_factory=dict)
    attributes: dict = field(default_factory=dict)
    records: int = 0
    record_size: int = 0
    #: Rows of the first dimension in a chunk, of files that are chunked.
    chunk_rows: int = 1
    #: The open file of the HDF5-based format, and bytes of values read from a classic one.
    file: hdf5.File | None = None
    read_bytes: int = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"file": self.file and self.file.path}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"file": state["file"] and hdf5.File(state["file"])})

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.records if self.dims[d][1] == 0 else self.dims[d][1] for d in v.dims)


class _Cursor:
    """Reads a header of any length from an open file."""

    def __init__(self, f):
        self.f = f

    def take(self, n: int) -> bytes:
        out = self.f.read(n)
        self.f.read(-n % 4)
        if len(out) < n:
            raise ValueError("the NetCDF header ends early")
        return out

    def number(self, kind: str = ">i") -> int:
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]

    def name(self) -> str:
        return self.take(self.number()).decode()

    def items(self, tag: int) -> range:
        found, n = self.number(), self.number()
        if found not in (0, tag):
            raise ValueError("not a NetCDF classic header")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.items(_ATTRIBUTE):
            name, kind, n = self.name(), self.number(), self.number()
            dtype = np.dtype(_TYPES[kind])
            raw = self.take(n * dtype.itemsize)
            out[name] = raw.decode() if kind == 2 else np.frombuffer(raw, dtype).tolist()
        return out


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        magic = f.read(4)
        if magic[:4] == b"\x89HDF":
            return _of_hdf5(path)
        if len(magic) < 4 or magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError(f"{path} is not a NetCDF classic file")
        c = _Cursor(f)
        out = Header(records=max(0, c.number()))
        out.dims = [(c.name(), c.number()) for _ in c.items(_DIMENSION)]
        out.attributes = c.attributes()
        for _ in c.items(_VARIABLE):
            name = c.name()
            dims = [c.number() for _ in range(c.number())]
            attributes, dtype, size = c.attributes(), np.dtype(_TYPES[c.number()]), c.number()
            begin = c.number(">i" if magic[3] == 1 else ">q")
            record = bool(dims) and out.dims[dims[0]][1] == 0
            out.variables[name] = Variable(name, dims, attributes, dtype, begin, record)
            out.record_size += size if record else 0
        alone = [v for v in out.variables.values() if v.record]
        if len(alone) == 1:
            # Records of a single variable follow each other without padding.
            out.record_size = int(np.prod(out.shape(alone[0])[1:], dtype=np.int64)) * alone[0].dtype.itemsize
    return out


def _of_hdf5(path: str) -> Header:
    """The same of a file of the HDF5-based format.  Dimensions are the datasets marked
    as scales; a variable lists those that it has by their addresses."""
    f = hdf5.File(path)
    out = Header(attributes=f.attributes, file=f)
    place: dict[int, int] = {}
    for name, d in f.datasets.items():
        if d.attributes.get("CLASS") == "DIMENSION_SCALE":
            place[d.address] = len(out.dims)
            out.dims.append((name, d.shape[0]))
    for name, d in f.datasets.items():
        if d.type.kind != "number" or str(d.attributes.get("NAME", "")).startswith("This is a netCDF dimension but not a netCDF variable"):
            continue
        if d.address in place:
            dims = [place[d.address]]
        else:
            listed = [k[0] if k else None for k in d.attributes.get("DIMENSION_LIST", [])]
            if len(listed) != len(d.shape) or any(k not in place for k in listed):
                if d.shape:
                    continue  # not on the file's grid
            dims = [place[k] for k in listed] if d.shape else []
        out.variables[name] = Variable(name, dims, d.attributes, d.type.dtype, 0)
        if d.chunk and len(dims) > 1:
            out.chunk_rows = max(out.chunk_rows, d.chunk[0])
    return out


def stamps(header: Header, name: str) -> tuple[float, np.datetime64] | None:
    """(seconds of a unit, epoch) of a coordinate that is a CF time."""
    v = header.variables.get(name)
    units = v.attributes.get("units") if v else None
    if not isinstance(units, str) or " since " not in units:
        return None
    return cf_time(units.rstrip("\0"), str(v.attributes.get("calendar", "standard")).rstrip("\0"))


def read_variable(path: str, header: Header, name: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Values of the rows lo to hi of the first dimension, as doubles; fill
    values become NaN, and scale_factor and add_offset are applied."""
    v = header.variables[name]
    shape = header.shape(v)
    hi = shape[0] if hi is None and shape else hi
    if header.file:
        return _unpacked(v, header.file.read(name, lo, hi))
    inner = int(np.prod(shape[1:], dtype=np.int64)) * v.dtype.itemsize
    with open(path, "rb") as f:
        if not shape:
            f.seek(v.begin)
            raw = f.read(v.dtype.itemsize)
        elif v.record:
            parts = []
            for k in range(lo, hi):
                f.seek(v.begin + k * header.record_size)
                parts.append(f.read(inner))
            raw = b"".join(parts)
        else:
            f.seek(v.begin + lo * inner)
            raw = f.read((hi - lo) * inner)
    header.read_bytes += len(raw)
    return _unpacked(v, np.frombuffer(raw, v.dtype).reshape((hi - lo, *shape[1:]) if shape else ()))


def _unpacked(v: Variable, raw: np.ndarray) -> np.ndarray:
    """Doubles, with fill values as NaN, scaled."""
    out = raw.astype(float)
    for fill in ("_FillValue", "missing_value"):
        if fill in v.attributes:
            out = np.where(out == v.attributes[fill][0], np.nan, out)
    return out * v.attributes.get("scale_factor", [1.0])[0] + v.attributes.get("add_offset", [0.0])[0]


def _layout(header: Header) -> tuple[list[int], list[str]]:
    """The dimensions of the widest variables, and those variables."""
    data = {n: v for n, v in header.variables.items() if n not in [d for d, _ in header.dims]}
    widest = max((v.dims for v in data.values()), key=len, default=[])
    return widest, [n for n, v in data.items() if v.dims == widest]


class _Piece(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


#: Cells of a partition, about.
CELLS = 1 << 20


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str], cells: int = CELLS):
        self.path, self.header, self.cells = path, read_header(path), cells
        self.dims, every = _layout(self.header)
        self.names = [n for n in every if n in names]
        self.least, self.most = -np.inf, np.inf

    def axis(self, k: int) -> np.ndarray:
        """Coordinates of a dimension; microseconds since 1970 where they are times."""
        name, size = self.header.dims[self.dims[k]]
        size = self.header.records if size == 0 and not self.header.file else size
        axis = read_variable(self.path, self.header, name) if name in self.header.variables else np.arange(size, dtype=float)
        if (cf := stamps(self.header, name)) is not None:
            return cf[1].astype("datetime64[us]") + np.round(axis * cf[0] * 1e6).astype("timedelta64[us]")
        return axis

    def partitions(self) -> list[InputPartition]:
        shape = [self.header.shape(Variable("", [d], {}, np.dtype(float), 0))[0] for d in self.dims] or [0]
        step = max(1, self.cells // max(1, int(np.prod(shape[1:], dtype=np.int64))))
        # Whole chunks, so that none is unpacked in two tasks.
        step = max(step // self.header.chunk_rows, 1) * self.header.chunk_rows
        first = self.axis(0).astype("float64") if shape[0] else np.empty(0)
        met = (first >= self.least) & (first <= self.most)
        return [_Piece(k, min(k + step, shape[0])) for k in range(0, shape[0], step) if met[k : k + step].any()] or [_Piece(0, 0)]

    def read(self, piece: _Piece) -> Iterator[pa.RecordBatch]:
        if piece.hi <= piece.lo:
            return
        axes = [self.axis(k)[piece.lo : piece.hi] if k == 0 else self.axis(k) for k in range(len(self.dims))]
        mesh = [m.ravel() for m in np.meshgrid(*axes, indexing="ij")]
        values = [read_variable(self.path, self.header, n, piece.lo, piece.hi).ravel() for n in self.names]
        columns = [pa.array(m) for m in mesh] + [pa.array(v, mask=np.isnan(v)) for v in values]
        yield pa.RecordBatch.from_arrays(columns, [self.header.dims[d][0] for d in self.dims] + self.names)


class _PruningReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the first dimension.  Spark still applies every filter, so a bound
        only has to be no narrower than its filter."""
        name = self.header.dims[self.dims[0]][0] if self.dims else None
        for f in filters:
            if getattr(f, "attribute", None) == (name,):
                given = [_as_number(v) for v in (f.value if isinstance(f, In) else [getattr(f, "value", None)])]
                if given and all(v is not None for v in given):
                    if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual)):
                        self.least = max(self.least, min(given))
                    if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)):
                        self.most = min(self.most, max(given))
            yield f


def _as_number(value) -> float | None:
    if isinstance(value, datetime):
        return float(np.datetime64(value.replace(tzinfo=None), "us").astype("int64"))
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


class NetCDF(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        header = read_header(self.options["path"])
        dims, names = _layout(header)
        wanted = json.loads(self.options.get("variables", "null"))
        if unknown := sorted(set(wanted or ()) - set(names)):
            raise ValueError(f"no variables on the grid of {self.options['path']}: {', '.join(unknown)}")
        kinds = [(header.dims[d][0], "timestamp_ntz" if stamps(header, header.dims[d][0]) else "double") for d in dims]
        return ", ".join(f"`{n}` {kind}" for n, kind in kinds + [(n, "double") for n in names if wanted is None or n in wanted])

    def reader(self, schema) -> DataSourceReader:
        kind = _PruningReader if self.options.get("pushdown") == "true" else _Reader
        return kind(self.options["path"], schema.names, int(self.options.get("cells", CELLS)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], json.loads(self.options["layout"]))


def variables_of(path: str, roles: list[str]) -> list[str] | None:
    """The variables of a file that have these roles, by the first name of each that it
    has; None, which stands for all, unless all are on its grid."""
    header = read_header(path)
    on_grid = _layout(header)[1]
    found = [next((n for n in ALIASES[r] if n in header.variables), None) for r in roles]
    return found if all(n in on_grid for n in found) else None


def read_netcdf(spark: SparkSession, path: str, variables: list[str] | None = None, cells: int = CELLS) -> DataFrame:
    """The whole file, or only `variables`, in partitions of about `cells` cells.  A
    missing file is an error at once, as is one in another format."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    read_header(path)
    spark.dataSource.register(NetCDF)
    # A reader that takes filters is an error where Spark does not offer them.
    reader = spark.read.format("netcdf").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).option("cells", cells)
    return (reader if variables is None else reader.option("variables", json.dumps(variables))).load(path)


def _head(axes: dict[str, np.ndarray], kinds: dict[str, str], attributes: dict[str, dict[str, str]], fill: float) -> tuple[bytes, dict[str, int]]:
    """The header of a CDF-2 file of variables (name: type) over all `axes`, and
    where the values of each axis and variable begin."""
    name = lambda s: struct.pack(">i", len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    tagged = lambda tag, items: struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    def text(key: str, value: str) -> bytes:
        return name(key) + struct.pack(">ii", 2, len(value.encode())) + value.encode() + b"\0" * (-len(value.encode()) % 4)

    cells = int(np.prod([len(a) for a in axes.values()], dtype=np.int64))
    parts = {n: ("f8", [k], len(a)) for k, (n, a) in enumerate(axes.items())} | {n: (t, list(range(len(axes))), cells) for n, t in kinds.items()}
    heads, sizes = {}, {}
    for n, (kind, dims, count) in parts.items():
        width = np.dtype(kind).itemsize
        filled = name("_FillValue") + struct.pack(">ii", _CODES[kind], 1) + struct.pack(">d" if kind == "f8" else ">f", fill)
        listed = tagged(_ATTRIBUTE, ([filled] if n in kinds else []) + [text(k, v) for k, v in attributes.get(n, {}).items()])
        sizes[n] = count * width + -count * width % 4
        heads[n] = name(n) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + listed + struct.pack(">ii", _CODES[kind], min(sizes[n], 2**31 - 4))
    start = b"CDF\x02" + struct.pack(">i", 0) + tagged(_DIMENSION, [name(n) + struct.pack(">i", len(a)) for n, a in axes.items()])
    start += tagged(_ATTRIBUTE, [text(k, v) for k, v in attributes.get("", {}).items()])
    at, begins, listed = len(start) + 8 + sum(len(h) + 8 for h in heads.values()), {}, []
    for n, head in heads.items():
        begins[n] = at
        listed.append(head + struct.pack(">q", at))
        at += sizes[n]
    return start + tagged(_VARIABLE, listed), begins


def write_netcdf(path: str, axes: dict[str, np.ndarray], variables: dict[str, np.ndarray], attributes: dict[str, dict[str, str]] | None = None, fill: float = -9999.0) -> None:
    """A CDF-2 file of arrays over all `axes`; missing values are written as `fill`."""
    head, begins = _head(axes, {n: "f8" for n in variables}, attributes or {}, fill)
    with open(path, "wb") as f:
        f.write(head)
        for n, values in [*axes.items(), *variables.items()]:
            f.seek(begins[n])
            f.write(np.where(np.isnan(values), fill, values).astype(">f8").tobytes())


@dataclass
class _Slices(WriterCommitMessage):
    """A file of an attempt, and the places on the time axis of the slices in it."""

    file: str
    places: list[int]


class _Writer(DataSourceArrowWriter):
    """Slices of one time each.  A task writes those of its rows, which come in the order
    of time, to a file of its own; the commit puts them in their places in a draft,
    slice by slice, which then takes the name of the file.  What a failed or repeated
    task left goes with the folder of attempts."""

    def __init__(self, path: str, layout: dict):
        self.path, self.layout = path, layout
        self.attempts = f"{path}.attempts-{layout['run']}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        times, lat, lon = (np.array(self.layout[k]) for k in ("times", "latitude", "longitude"))
        names, fill = self.layout["variables"], self.layout["fill"]
        Path(self.attempts).mkdir(parents=True, exist_ok=True)
        file, places = f"{self.attempts}/{uuid.uuid4().hex}", []
        held = np.full((len(names), len(lat) * len(lon)), fill, ">f4")
        with open(file, "wb") as f:
            for batch in batches:
                col = lambda n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                at = np.searchsorted(times, col("time").astype("datetime64[us]").astype("int64"))
                cell = np.searchsorted(lat, col("latitude")) * len(lon) + np.searchsorted(lon, col("longitude"))
                values = [np.where(np.isnan(v), fill, v) for v in (col(n).astype(float) for n in names)]
                cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b == a:
                        continue
                    if not places or places[-1] != at[a]:
                        if places:
                            f.write(held.tobytes())
                        if at[a] in places:
                            raise ValueError("the rows of a time are not together")
                        places.append(int(at[a]))
                        held[:] = fill
                    for own, v in zip(held, values, strict=True):
                        own[cell[a:b]] = v[a:b]
            if places:
                f.write(held.tobytes())
        return _Slices(file, places)

    def commit(self, messages: list[_Slices | None]) -> None:
        lat, lon = (np.array(self.layout[k], float) for k in ("latitude", "longitude"))
        hours = np.array(self.layout["times"], float) / 3.6e9
        axes = {"time": hours, "latitude": lat, "longitude": lon}
        names, size = self.layout["variables"], len(lat) * len(lon) * 4
        head, begins = _head(axes, {n: "f4" for n in names}, self.layout["attributes"], self.layout["fill"])
        draft, blank = f"{self.attempts}/draft", np.full(size // 4, self.layout["fill"], ">f4").tobytes()
        Path(self.attempts).mkdir(parents=True, exist_ok=True)
        with open(draft, "wb") as f:
            f.write(head)
            for n, axis in axes.items():
                f.seek(begins[n])
                f.write(axis.astype(">f8").tobytes())
            missing = set(range(len(hours))) - {k for m in messages if m for k in m.places}
            for n in names:
                for k in missing:
                    f.seek(begins[n] + k * size)
                    f.write(blank)
            for m in messages:
                if not m or not m.places:
                    continue
                with open(m.file, "rb") as part:
                    for k in m.places:
                        for n in names:
                            f.seek(begins[n] + k * size)
                            f.write(part.read(size))
        Path(draft).replace(self.path)
        shutil.rmtree(self.attempts, ignore_errors=True)

    def abort(self, messages: list[_Slices | None]) -> None:
        shutil.rmtree(self.attempts, ignore_errors=True)


def write_raster(raster: DataFrame, path: str, variables: list[str], attributes: dict[str, dict[str, str]] | None = None, fill: float = -9999.0) -> None:
    """Writes a table (time, latitude, longitude, variables) as a CDF-2 file of
    floats, time in hours since 1970; cells that are not in it are `fill`.

    The axes are collected.  A file that is there is replaced when the new one is
    complete; a run that fails leaves it as it was."""
    spark = raster.sparkSession
    axes = {c: sorted(r[0] for r in raster.select(c).distinct().collect()) for c in ("time", "latitude", "longitude")}
    named = {"time": {"units": "hours since 1970-01-01 00:00:00", "calendar": "proleptic_gregorian"}} | (attributes or {})
    layout = {
        "run": uuid.uuid4().hex, "times": np.array(axes["time"], "datetime64[us]").astype("int64").tolist(), "variables": variables, "attributes": named, "fill": fill,
        **{c: [float(v) for v in axes[c]] for c in ("latitude", "longitude")},
    }
    rows = raster.select("time", *[F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")], *[F.col(v).cast("float").alias(v) for v in variables])
    spark.dataSource.register(NetCDF)
    ordered = rows.repartition("time").sortWithinPartitions("time")
    ordered.write.format("netcdf").mode("append").option("layout", json.dumps(layout)).save(path)
