import socket
import struct
import threading

import numpy as np
import pytest

from lumenflow.functions import apply
from lumenflow.operators import devices as D
from lumenflow.spec import FlowError


def serve(handle):
    """A server on a free port; `handle(connection)` in a thread for each."""
    s = socket.create_server(("127.0.0.1", 0))

    def loop():
        while True:
            try:
                c, _ = s.accept()
            except OSError:
                return
            threading.Thread(target=lambda c=c: (handle(c), c.close()), daemon=True).start()

    threading.Thread(target=loop, daemon=True).start()
    return s, s.getsockname()[1]


def test_lines_over_sockets(spark):
    got, done = [], threading.Event()

    def take(c):
        data = b""
        while part := c.recv(4096):
            data += part
        got.append(data)
        done.set()

    s, port = serve(take)
    df = spark.createDataFrame([("one",), ("zwei é",)], "data string").coalesce(1)
    assert [r["bytes"] for r in apply("TcpSend", df, port=port).collect()] == [4, 8]
    assert done.wait(5) and got == ["one\nzwei é\n".encode()]
    s.close()
    s, port = serve(lambda c: c.sendall(b"a\nb\n"))
    assert [r["data"] for r in apply("TcpReceive", spark.range(1), port=port).collect()] == ["a", "b"]
    s.close()


def test_registers(spark):
    held = {7: 41}

    def answer(c):
        head = D._exactly(c, 7)
        body = D._exactly(c, struct.unpack(">H", head[4:6])[0] - 1)
        code, at, value = struct.unpack(">BHH", body)
        if code == 6:
            held[at] = value
            out = body
        else:
            out = struct.pack(">BBH", 3, 2, held[at]) if at in held else bytes([0x83, 2])
        c.sendall(struct.pack(">HHHB", 1, 0, len(out) + 1, 1) + out)

    s, port = serve(answer)
    assert apply("ModbusRead", spark.range(1), port=port, reg_address=7).first()["value"] == 41
    assert apply("ModbusWrite", spark.createDataFrame([(99.0,)], "value double"), port=port, reg_address=8).count() == 1 and held[8] == 99
    with pytest.raises(Exception, match="modbus exception 2"):
        apply("ModbusRead", spark.range(1), port=port, reg_address=1).collect()
    with pytest.raises(FlowError):
        apply("ModbusWrite", spark.createDataFrame([(1.0,)], "value double"), reg_type="input")
    s.close()


def test_plc_memory(spark):
    memory = bytearray(64)

    def answer(c):
        def reply(parameter, data=b""):
            body = b"\x02\xf0\x80" + struct.pack(">BBHHHHH", 0x32, 3, 0, 1, len(parameter), len(data), 0) + parameter + data
            c.sendall(struct.pack(">BBH", 3, 0, len(body) + 4) + body)

        try:
            while True:
                body = D._exactly(c, struct.unpack(">BBH", D._exactly(c, 4))[2] - 4)
                if body[1] == 0xE0:
                    c.sendall(struct.pack(">BBH", 3, 0, 11) + bytes([6, 0xD0, 0, 1, 0, 1, 0]))
                    continue
                n, m = struct.unpack(">HH", body[3 + 6 : 3 + 10])
                p, d = body[13 : 13 + n], body[13 + n : 13 + n + m]
                if p[0] == 4:
                    at, size = int.from_bytes(p[11:14], "big") // 8, struct.unpack(">H", p[6:8])[0]
                    reply(p[:2], struct.pack(">BBH", 0xFF, 4, size * 8) + bytes(memory[at : at + size]))
                elif p[0] == 5:
                    at = int.from_bytes(p[11:14], "big") // 8
                    memory[at : at + len(d) - 4] = d[4:]
                    reply(p[:2], b"\xff")
                else:
                    reply(p[:1])
        except ConnectionError:
            pass

    s, port = serve(answer)
    ip = f"127.0.0.1:{port}"
    assert apply("S7Write", spark.createDataFrame([(-12.0,)], "value double"), ip=ip, address=4).count() == 1
    assert apply("S7Read", spark.range(1), ip=ip, address=4).first()["value"] == -12
    apply("S7Write", spark.createDataFrame([(2.5,)], "value double"), ip=ip, address=8, data_type="real").collect()
    assert apply("S7Read", spark.range(1), ip=ip, address=8, data_type="real").first()["value"] == 2.5
    assert apply("S7Control", spark.range(1), ip=ip).first()["status"] == "connected"
    assert apply("S7Control", spark.range(1), ip=ip, operation="stop").first()["status"] == "stopped"
    s.close()


def test_files(spark, tmp_path):
    frames = spark.createDataFrame([(3, 2, 2, 1, "Mono8", 0, "s", bytearray(b"\x01\x02\x03\x04"))], "frame_id long, width int, height int, channels int, format string, timestamp_us long, source_id string, data binary")
    assert apply("ImageSave", frames, filepath=str(tmp_path / "out.raw")).first()["bytes"] == 4
    assert (tmp_path / "out" / "3.raw").read_bytes() == b"\x01\x02\x03\x04"
    points = np.array([[1, 2, 3], [4.5, 5, 6]], "<f4")
    (tmp_path / "a.pcd").write_bytes(b"VERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA binary\n" + points.tobytes())
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nelement face 0\nend_header\n1 2 3\n4.5 5 6\n")
    for name in ("a.pcd", "b.ply"):
        got = apply("PointCloudFromFile", filepath=str(tmp_path / name)).orderBy("point_id").collect()
        assert [(r["x"], r["y"], r["z"]) for r in got] == [(1, 2, 3), (4.5, 5, 6)]
    pairs = [(0, "SECTION"), (2, "ENTITIES"), (0, "LINE"), (8, "a"), (10, 0), (20, 0), (11, 3), (21, 4), (0, "CIRCLE"), (8, "b"), (10, 1), (20, 2), (40, 5), (0, "LWPOLYLINE"), (8, "a"), (70, 1), (10, 0), (20, 0), (10, 2), (20, 0), (10, 2), (20, 2), (0, "ENDSEC"), (0, "EOF")]
    (tmp_path / "c.dxf").write_text("\n".join(f"{a}\n{b}" for a, b in pairs))
    got = apply("DXFLoader", filepath=str(tmp_path / "c.dxf"), scale=2.0).collect()
    assert [r["entity"] for r in got] == ["LINE", "CIRCLE", "LINE", "LINE", "LINE"] and got[0]["x2"] == 6 and got[1]["radius"] == 10
    assert apply("DXFLoader", filepath=str(tmp_path / "c.dxf"), layer_filter="b").count() == 1


def test_cameras_meet_at_triggers(spark):
    rows = [(k * 10 + c, f"cam{c}", k * 100_000 + c * 300) for k in range(4) for c in range(3)] + [(99, "cam0", 200_900)]
    got = {r["trigger_id"]: r for r in apply("MultiCameraAcquire", spark.createDataFrame(rows, "frame_id long, source_id string, timestamp_us long"), frame_rate=10.0, tolerance_us=600.0).collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[2]["frame_ids"] == [20, 21, 22] and got[2]["spread_us"] == 600 and got[2]["sync_status"]
    assert not apply("MultiCameraAcquire", spark.createDataFrame(rows, "frame_id long, source_id string, timestamp_us long"), frame_rate=10.0, cameras_config="cam0,cam9").first()["sync_status"]
