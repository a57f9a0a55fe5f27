"""Page capture from a server on this machine; the object store's sink."""

import hashlib
import http.server
import threading
import time

import pytest

from attestra.sources import capture as K
from attestra.sources import objects as O


class Pages(http.server.BaseHTTPRequestHandler):
    asked: list[tuple[str, float]] = []

    def do_GET(self):
        Pages.asked.append((self.path, time.monotonic()))
        code = {"/moved": 302, "/missing": 404, "/broken": 503}.get(self.path, 200)
        self.send_response(code)
        if code == 302:
            self.send_header("Location", "/good")
        self.end_headers()
        if self.path == "/large":
            self.wfile.write(b"x" * 5000)
        elif self.path == "/slow":
            time.sleep(2)
        elif code == 200:
            self.wfile.write(b"<p>" + self.path.encode() + b"</p>")

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s.server_address[1]
    s.shutdown()


def home(host, port):
    return ["127.0.0.1"]


def test_captures(spark, server):
    at = f"http://site.test:{server}"
    policy = K.Policy(hosts=("site.test", "inside.test", "gone.test"), interval=0.2, timeout=1.0, most_bytes=1000, local=("site.test",), resolve=home)
    urls = [f"{at}/{p}" for p in ("good", "good", "moved", "missing", "broken", "large", "slow")] + [f"http://inside.test:{server}/good", "ftp://site.test/x", f"http://me:pw@site.test:{server}/", "http://other.test/", None, "http://[bad/", f"http://site.test:{server}/a?b=c#d"]
    Pages.asked.clear()
    rows = K.captures(spark.createDataFrame([(u, 1) for u in urls], "url string, host int"), policy).collect()
    assert len(rows) == len(set(urls))
    got = {r.url.removeprefix(at): (r.status, r.code, r.retryable) for r in rows}
    assert got["/good"] == ("CAPTURED", 200, False) and got["/moved"] == ("REDIRECT", 302, False) and got["/missing"] == ("ERROR", 404, False) and got["/broken"] == ("ERROR", 503, True)
    assert got["/large"] == ("TOO_LARGE", 200, False) and got["/slow"][0] == "TIMEOUT" and got["/slow"][2] and got["/a?b=c#d"][0] == "CAPTURED"
    assert got[f"http://inside.test:{server}/good"] == ("ADDRESS", None, False)
    assert {got["ftp://site.test/x"][0], got[f"http://me:pw@site.test:{server}/"][0], got["http://other.test/"][0]} == {"SCHEME", "CREDENTIALS", "HOST"} and got[""][0] in ("SCHEME", "URL") and got["http://[bad/"][0] in ("URL", "HOST")
    good = next(r for r in rows if r.url == f"{at}/good")
    assert good.content == b"<p>/good</p>" and good.sha256 == hashlib.sha256(good.content).hexdigest() and good.bytes == 12
    times = sorted(t for _, t in Pages.asked)
    assert len(times) == 7 and all(b - a >= 0.19 for a, b in zip(times, times[1:], strict=False))  # one task, paced


def test_addresses():
    policy = K.Policy(hosts=("h",), resolve=lambda h, p: ["93.184.216.34", "10.0.0.1"])
    assert policy.address("h", 80) is None and K.Policy(hosts=(), resolve=lambda h, p: ["93.184.216.34"]).address("h", 80) == "93.184.216.34"
    assert K.Policy(hosts=(), resolve=lambda h, p: ["169.254.169.254"]).address("h", 80) is None


def test_objects_once_and_whole(spark, tmp_path):
    root = f"{tmp_path}/store"
    rows = [(1, b"one"), (2, b"two"), (3, b"one"), (4, b""), (5, None)] + [(10 + k, b"one") for k in range(50)]
    frame = spark.createDataFrame(rows, "id int, content binary").repartition(4)
    kept = O.put(frame, root)
    O.put(frame, root)  # again
    files = {str(p.relative_to(root)): p.read_bytes() for p in (tmp_path / "store").rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert sorted(files.values()) == [b"", b"one", b"two"]
    assert all(k == O.key_for(hashlib.sha256(v).hexdigest()) for k, v in files.items())
    assert not any((tmp_path / "store" / O.ATTEMPTS).glob("*"))
    back = {r.storage_key: r.content for r in O.get(spark, root, kept.select("storage_key").distinct()).collect()}
    assert {k: bytes(v) for k, v in back.items() if v is not None}.items() >= {O.key_for(hashlib.sha256(x).hexdigest()): x for x in (b"one", b"two")}.items()


def test_a_failing_task_leaves_no_part(spark, tmp_path):
    root = f"{tmp_path}/store"
    spark.dataSource.register(O.ObjectStore)
    bad = spark.createDataFrame([(b"good", hashlib.sha256(b"good").hexdigest()), (b"bad", "0" * 64)], "content binary, content_sha256 string").coalesce(1)
    with pytest.raises(Exception, match="differs from its digest"):
        bad.write.format("objects").mode("append").save(root)
    files = [p.name for p in (tmp_path / "store").rglob("*") if p.is_file()]
    assert files == [hashlib.sha256(b"good").hexdigest()] and not any((tmp_path / "store" / O.ATTEMPTS).glob("*"))
    with pytest.raises(Exception, match="append"):
        bad.write.format("objects").mode("overwrite").save(root)


@pytest.mark.parametrize("key", ["../../etc/passwd", "aa/bb/" + "c" * 64, "aa/bb/aabb", "", "AA/BB/" + "AABB" + "c" * 60])
def test_keys_stay_inside(key):
    with pytest.raises(ValueError):
        O.contained(key)
    assert O.contained(O.key_for("ab" * 32))
