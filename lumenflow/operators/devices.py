"""Sources and sinks as operators: files, sockets, fieldbus registers, PLC memory and cameras.

A sink does its work when its result is read, in the tasks that hold the rows, and gives a row for each thing it has
sent or written; a task that runs again writes the same file or register again. Paths are of a file system that all
executors reach.
"""

from __future__ import annotations

import socket
import struct
from collections.abc import Callable, Iterator
from contextlib import closing

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..spec import FlowError, Operator, register
from .measures import table_op


def _by_row(df: DataFrame, step: Callable[[dict], dict | None], fields: str) -> DataFrame:
    """A row of `fields` for each row for which `step` gives one."""
    ship(df.sparkSession)
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [x for x in (step(r) for r in b.to_dict("records")) if x is not None]
            if got:
                yield pd.DataFrame(got, columns=names)

    return df.mapInPandas(run, fields)


# --- files


def store(path: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _saved(image: DataFrame, filepath: str, format: str) -> DataFrame:
    if format not in ("raw", "pgm"):
        raise FlowError("ImageSave writes raw or pgm; for tables see lumenflow.sources.sinks.save_frames")
    folder = filepath.rsplit(".", 1)[0] if "." in filepath.rsplit("/", 1)[-1] else filepath.rstrip("/")

    def write(row: dict) -> dict | None:
        if row["data"] is None:
            return None
        system, at = store(f"{folder}/{row['frame_id']}.{format}")
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        head = f"P{'6' if row['channels'] == 3 else '5'}\n{row['width']} {row['height']}\n255\n".encode() if format == "pgm" else b""
        with system.open_output_stream(at) as out:
            out.write(head + row["data"])
        return {"frame_id": row["frame_id"], "filepath": at, "bytes": len(head) + len(row["data"])}

    return _by_row(image.select("frame_id", "width", "height", "channels", "data"), write, "frame_id long, filepath string, bytes long")


register(Operator("ImageSave", "sink", {"filepath": "output.raw", "format": "raw"}, ("image",), ("frame_id", "filepath", "bytes"), _saved))


def _points(filepath: str, file_format: int) -> DataFrame:
    """0: told by the name's end; 1: PCD; 2: PLY. Text and little-endian binary files, a cloud each."""
    spark = SparkSession.active()
    ship(spark)
    files = spark.read.format("binaryFile").load(filepath).select(F.xxhash64("path").alias("cloud_id"), "path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cloud, path, content in zip(b["cloud_id"], b["path"], b["content"], strict=True):
                kind = {1: "pcd", 2: "ply"}.get(file_format) or path.rsplit(".", 1)[-1].lower()
                p = (read_ply if kind == "ply" else read_pcd)(content)
                yield pd.DataFrame({"cloud_id": cloud, "point_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return files.mapInPandas(run, "cloud_id long, point_id long, x double, y double, z double")


def _table(head: list[tuple[str, str]], body: bytes, n: int, binary: bool) -> np.ndarray:
    names = [a for a, _ in head]
    at = [names.index(a) for a in "xyz"]
    if binary:
        rows = np.frombuffer(body, np.dtype([(f"{a}{k}", t) for k, (a, t) in enumerate(head)]), n)
        return np.stack([rows[f"{names[k]}{k}"].astype(np.float64) for k in at], 1)
    rows = [line.split() for line in body.decode("latin-1").splitlines()[:n]]
    return np.array([[float(r[k]) for k in at] for r in rows], np.float64).reshape(-1, 3)


def read_pcd(content: bytes) -> np.ndarray:
    end = content.index(b"\n", content.index(b"DATA")) + 1
    head = dict(line.split(None, 1) for line in content[:end].decode("latin-1").splitlines() if line and line[0] != "#")
    counts = [int(c) for c in head.get("COUNT", " ".join("1" for _ in head["FIELDS"].split())).split()]
    kinds = {"F": "f", "I": "i", "U": "u"}
    fields = [(a if c == 1 else f"{a}_{k}", f"<{kinds[t]}{size}") for a, t, size, c in zip(head["FIELDS"].split(), head["TYPE"].split(), head["SIZE"].split(), counts, strict=True) for k in range(c)]
    mode = head["DATA"].strip()
    if mode == "binary_compressed":
        raise ValueError("compressed PCD files are not read")
    return _table(fields, content[end:], int(head["POINTS"]), mode == "binary")


#: Names of numbers in PLY files.
PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def read_ply(content: bytes) -> np.ndarray:
    end = content.index(b"end_header") + len(b"end_header\n")
    fields, n, here, order = [], 0, False, "<"
    for line in content[:end].decode("latin-1").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[word[1]]
        elif word[:1] == ["element"]:
            here = word[1] == "vertex"
            n = int(word[2]) if here else n
        elif word[:1] == ["property"] and here:
            fields.append((word[2], order + PLY[word[1]]))
    return _table(fields, content[end:], n, bool(order))


register(Operator("PointCloudFromFile", "source", {"filepath": "", "file_format": 0}, (), ("cloud_id", "point_id", "x", "y", "z"), _points))


def dxf_entities(text: str, scale: float = 1.0, step: float = 1.0) -> list[dict]:
    """LINE, CIRCLE, ARC and POINT entities and the segments of LWPOLYLINE, from pairs of code and value."""
    lines = [x.strip() for x in text.splitlines()]
    pairs = [(int(a), b) for a, b in zip(lines[::2], lines[1::2], strict=False) if a.lstrip("-").isdigit()]
    out, here, kind, values = [], False, None, []

    def close() -> None:
        v: dict[int, list[str]] = {}
        for c, x in values:
            v.setdefault(c, []).append(x)
        num = lambda c, k=0: float(v.get(c, ["0"] * (k + 1))[k]) * scale
        row = {"entity": kind, "layer": v.get(8, ["0"])[0], "x1": num(10), "y1": num(20), "z1": num(30), "x2": num(10), "y2": num(20), "z2": num(30), "radius": 0.0, "start_angle": 0.0, "end_angle": 360.0}
        if kind == "LINE":
            out.append(row | {"x2": num(11), "y2": num(21), "z2": num(31)})
        elif kind in ("CIRCLE", "ARC"):
            out.append(row | {"radius": num(40)} | ({"start_angle": float(v.get(50, ["0"])[0]), "end_angle": float(v.get(51, ["360"])[0])} if kind == "ARC" else {}))
        elif kind == "POINT":
            out.append(row)
        elif kind == "LWPOLYLINE":
            n = len(v.get(10, []))
            for k in range(n if int(v.get(70, ["0"])[0]) & 1 else n - 1):
                j = (k + 1) % n
                out.append(row | {"entity": "LINE", "x1": num(10, k), "y1": num(20, k), "x2": num(10, j), "y2": num(20, j)})

    for code, value in pairs:
        if code == 0:
            if here and kind:
                close()
            kind, values = value, []
            here = here and value != "ENDSEC"
        elif code == 2 and kind == "SECTION":
            here, kind = value == "ENTITIES", None
        else:
            values.append((code, value))
    return out


ENTITY = "geometry_id long, entity string, layer string, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, radius double, start_angle double, end_angle double"


def _dxf(filepath: str, scale: float, layer_filter: str, extract_edges: bool, edge_sample_step: float) -> DataFrame:
    """Rows of entities of every file; with a layer filter, those of the named layers (comma-separated)."""
    spark = SparkSession.active()
    ship(spark)
    files = spark.read.format("binaryFile").load(filepath).select(F.xxhash64("path").alias("geometry_id"), "content")
    layers = [x.strip() for x in layer_filter.split(",") if x.strip()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, content in zip(b["geometry_id"], b["content"], strict=True):
                rows = [{"geometry_id": i} | e for e in dxf_entities(content.decode("latin-1"), scale) if not layers or e["layer"] in layers]
                if rows:
                    yield pd.DataFrame(rows)

    return files.mapInPandas(run, ENTITY)


register(Operator("DXFLoader", "source", {"filepath": "", "scale": 1.0, "layer_filter": "", "extract_edges": True, "edge_sample_step": 1.0}, (), tuple(f.split()[0] for f in ENTITY.split(", ")), _dxf))


# --- sockets


def _sent(data: DataFrame, address: str, port: int) -> DataFrame:
    """Each row's `data` as a line; one connection a task."""
    ship(data.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with closing(socket.create_connection((address, int(port)), 10)) as s:
            for b in batches:
                for x in b["data"]:
                    s.sendall((x or "").encode() + b"\n")
                yield pd.DataFrame({"data": b["data"], "bytes": [len((x or "").encode()) + 1 for x in b["data"]]})

    return data.select(F.col("data").cast("string").alias("data")).mapInPandas(run, "data string, bytes long")


register(Operator("TcpSend", "sink", {"address": "127.0.0.1", "port": 8888}, ("data",), ("data", "bytes"), _sent))


def _received(trigger: DataFrame, address: str, port: int, timeout: int) -> DataFrame:
    """For each trigger row, the lines that come until the peer closes or nothing comes for `timeout` milliseconds."""

    def read(row: dict) -> dict:
        got = b""
        with closing(socket.create_connection((address, int(port)), 10)) as s:
            s.settimeout(timeout / 1000)
            try:
                while part := s.recv(65536):
                    got += part
            except TimeoutError:
                pass
        return {"data": got.decode("utf-8", "replace")}

    return _by_row(trigger, read, "data string").select(F.explode(F.split(F.regexp_replace("data", r"\n\z", ""), "\n")).alias("data")).filter("data <> ''")


register(Operator("TcpReceive", "source", {"address": "127.0.0.1", "port": 8888, "timeout": 1000}, ("trigger",), ("data",), _received))


def _exactly(s: socket.socket, n: int) -> bytes:
    out = b""
    while len(out) < n:
        part = s.recv(n - len(out))
        if not part:
            raise ConnectionError("closed early")
        out += part
    return out


#: Function codes of the Modbus protocol, to read and to write one.
MODBUS = {"coil": (1, 5), "discrete": (2, None), "holding": (3, 6), "input": (4, None)}


def modbus(address: str, port: int, unit: int, body: bytes) -> bytes:
    """The answer's body to one request; an exception code is an error."""
    with closing(socket.create_connection((address, int(port)), 10)) as s:
        s.sendall(struct.pack(">HHHB", 1, 0, len(body) + 1, int(unit)) + body)
        size = struct.unpack(">HHHB", _exactly(s, 7))[2]
        answer = _exactly(s, size - 1)
    if answer[0] & 0x80:
        raise OSError(f"modbus exception {answer[1]}")
    return answer


def _register_kind(reg_type: str, write: bool) -> int:
    code = MODBUS.get(reg_type, (None, None))[write]
    if code is None:
        raise FlowError(f"{reg_type} registers cannot be {'written' if write else 'read'}")
    return code


def _modbus_read(trigger: DataFrame, address: str, port: int, unit_id: int, reg_address: int, reg_type: str) -> DataFrame:
    code = _register_kind(reg_type, False)

    def read(row: dict) -> dict:
        got = modbus(address, port, unit_id, struct.pack(">BHH", code, int(reg_address), 1))
        return {"value": float(got[2] & 1 if code < 3 else struct.unpack(">H", got[2:4])[0])}

    return _by_row(trigger, read, "value double")


def _modbus_write(value: DataFrame, address: str, port: int, unit_id: int, reg_address: int, reg_type: str) -> DataFrame:
    code = _register_kind(reg_type, True)

    def write(row: dict) -> dict:
        v = int(row["value"])
        modbus(address, port, unit_id, struct.pack(">BHH", code, int(reg_address), (0xFF00 if v else 0) if code == 5 else v & 0xFFFF))
        return {"value": float(v)}

    return _by_row(value.select("value"), write, "value double")


_FIELD = {"address": "127.0.0.1", "port": 502, "unit_id": 1, "reg_address": 0, "reg_type": "holding"}
register(Operator("ModbusRead", "source", _FIELD, ("trigger",), ("value",), _modbus_read))
register(Operator("ModbusWrite", "sink", _FIELD, ("value",), ("value",), _modbus_write))


# --- Siemens S7 over ISO-on-TCP

#: Codes of memory areas, and of items with their sizes in bytes.
AREAS = {"DB": 0x84, "M": 0x83, "I": 0x81, "Q": 0x82}
ITEMS = {"bool": (1, ">B"), "byte": (1, ">B"), "word": (2, ">H"), "int": (2, ">h"), "dword": (4, ">I"), "dint": (4, ">i"), "real": (4, ">f")}


class S7:
    def __init__(self, ip: str, rack: int, slot: int, port: int = 102):
        self.socket = socket.create_connection((ip, port), 10)
        self._send(bytes([17, 0xE0, 0, 0, 0, 1, 0, 0xC0, 1, 10, 0xC1, 2, 1, 0, 0xC2, 2, 1, rack * 32 + slot]))
        self._receive()
        self._ask(struct.pack(">BBHHH", 0xF0, 0, 1, 1, 480), b"")

    def _send(self, body: bytes) -> None:
        self.socket.sendall(struct.pack(">BBH", 3, 0, len(body) + 4) + body)

    def _receive(self) -> bytes:
        return _exactly(self.socket, struct.unpack(">BBH", _exactly(self.socket, 4))[2] - 4)

    def _ask(self, parameter: bytes, data: bytes) -> tuple[bytes, bytes]:
        self._send(b"\x02\xf0\x80" + struct.pack(">BBHHHH", 0x32, 1, 0, 1, len(parameter), len(data)) + parameter + data)
        got = self._receive()[3:]
        n, m, error = struct.unpack(">HHH", got[6:12])
        if error:
            raise OSError(f"S7 error {error:#x}")
        return got[12 : 12 + n], got[12 + n : 12 + n + m]

    def _item(self, code: int, area: str, db: int, address: int, bit: int, size: int, is_bit: bool) -> bytes:
        return struct.pack(">BBBBBBHHB", code, 1, 0x12, 10, 0x10, 1 if is_bit else 2, 1 if is_bit else size, db if area == "DB" else 0, AREAS[area]) + (address * 8 + bit).to_bytes(3, "big")

    def read(self, area: str, db: int, address: int, kind: str, bit: int) -> float:
        size, form = ITEMS[kind]
        _, data = self._ask(self._item(4, area, db, address, bit if kind == "bool" else 0, size, kind == "bool"), b"")
        if data[0] != 0xFF:
            raise OSError(f"S7 item error {data[0]:#x}")
        return float(struct.unpack(form, data[4 : 4 + size])[0])

    def write(self, area: str, db: int, address: int, kind: str, bit: int, value: float) -> None:
        size, form = ITEMS[kind]
        body = struct.pack(form, value if kind == "real" else int(value))
        data = struct.pack(">BBH", 0, 3 if kind == "bool" else 4, 1 if kind == "bool" else 8 * size) + body
        _, got = self._ask(self._item(5, area, db, address, bit if kind == "bool" else 0, size, kind == "bool"), data)
        if got[0] != 0xFF:
            raise OSError(f"S7 item error {got[0]:#x}")

    def control(self, operation: str) -> str:
        if operation == "stop":
            self._ask(b"\x29\x00\x00\x00\x00\x00\x09P_PROGRAM", b"")
        elif operation == "start":
            self._ask(b"\x28\x00\x00\x00\x00\x00\x00\xfd\x00\x00\x09P_PROGRAM", b"")
        elif operation != "info":
            raise FlowError(f"unknown operation {operation}")
        return {"info": "connected", "stop": "stopped", "start": "started"}[operation]


def _plc(ip: str, rack: int, slot: int) -> S7:
    host, _, port = ip.partition(":")
    return S7(host, int(rack), int(slot), int(port or 102))


_ITEM = {"ip": "192.168.0.1", "rack": 0, "slot": 1, "area": "DB", "db_number": 1, "address": 0, "data_type": "int", "bit_offset": 0}


def _s7_read(trigger: DataFrame, ip: str, rack: int, slot: int, area: str, db_number: int, address: int, data_type: str, bit_offset: int) -> DataFrame:
    return _by_row(trigger, lambda _: {"value": _plc(ip, rack, slot).read(area, int(db_number), int(address), data_type, int(bit_offset))}, "value double")


def _s7_write(value: DataFrame, ip: str, rack: int, slot: int, area: str, db_number: int, address: int, data_type: str, bit_offset: int) -> DataFrame:
    def write(row: dict) -> dict:
        _plc(ip, rack, slot).write(area, int(db_number), int(address), data_type, int(bit_offset), row["value"])
        return {"value": float(row["value"])}

    return _by_row(value.select("value"), write, "value double")


register(Operator("S7Read", "source", _ITEM, ("trigger",), ("value",), _s7_read))
register(Operator("S7Write", "sink", _ITEM, ("value",), ("value",), _s7_write))
register(Operator("S7Control", "sink", {"ip": "192.168.0.1", "rack": 0, "slot": 1, "operation": "info"}, ("trigger",), ("status",), lambda trigger, ip, rack, slot, operation: _by_row(trigger, lambda _: {"status": _plc(ip, rack, slot).control(operation)}, "status string")))


# --- cameras


@table_op("MultiCameraAcquire", "frames", "trigger_id camera_ids frame_ids timestamps spread_us sync_status", sync_mode="software", frame_rate=30.0, cameras_config="", tolerance_us=1000.0, timeout_ms=1000, continuous=False, buffer_size=100)
def multi_camera(frames, sync_mode, frame_rate, cameras_config, tolerance_us, timeout_ms, continuous, buffer_size):
    """One row for every trigger: the frames (frame_id, source_id, timestamp_us) of all cameras nearest to it.

    The trigger of a frame is the nearest multiple of the frame interval, so frames meet by an equality, with partial
    aggregation, however many there are. Of several frames of one camera at a trigger the nearest counts, then the
    least frame. A trigger is in step if all cameras (those configured, or all that it has) have a frame and these lie
    within the tolerance.
    """
    if sync_mode not in ("software", "hardware", "master_slave"):
        raise FlowError(f"unknown sync_mode {sync_mode}")
    interval = 1e6 / frame_rate
    wanted = [c.strip() for c in cameras_config.split(",") if c.strip()]
    rows = frames.filter(F.col("source_id").isin(wanted)) if wanted else frames
    at = F.floor(F.col("timestamp_us") / interval + 0.5).cast("long")
    rows = rows.select(at.alias("trigger_id"), F.col("source_id").cast("string").alias("camera"), "frame_id", "timestamp_us")
    off = F.abs(F.col("timestamp_us") - F.col("trigger_id") * interval)
    near = rows.groupBy("trigger_id", "camera").agg(F.min(F.struct(off.alias("off"), "frame_id", "timestamp_us")).alias("f"))
    each = near.groupBy("trigger_id").agg(F.sort_array(F.collect_list(F.struct("camera", "f.frame_id", "f.timestamp_us"))).alias("c"), (F.max("f.timestamp_us") - F.min("f.timestamp_us")).alias("spread_us"))
    whole = F.size("c") >= (len(wanted) or 1)
    return each.select("trigger_id", F.col("c.camera").alias("camera_ids"), F.col("c.frame_id").alias("frame_ids"), F.col("c.timestamp_us").alias("timestamps"), "spread_us", (whole & (F.col("spread_us") <= tolerance_us)).alias("sync_status"))
