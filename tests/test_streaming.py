import threading
import time
import urllib.request

from colligo import Catalog, Collection, Engine
from colligo.streaming.http import RequestServer, receive
from colligo.streaming.stream import parquet_stream, run_stream


def test_file_stream_equals_batch(spark, sf):
    from colligo.plans import catalogue

    stream = {tuple(r) for r in catalogue.QUERIES["stream_route"](spark, sf).collect()}
    events = spark.read.parquet(f"{sf}/events.parquet")
    want = {(r["event_id"], {"purchase": "sell", "error": "alarm"}.get(r["event_type"], "ignore")) for r in events.collect() if r["event_type"] != "view"}
    assert stream == want


def test_foreach_over_a_stream_reaches_its_sink(spark, sf):
    stream = parquet_stream(spark, f"{sf}/events.parquet")
    cat = Catalog(spark)
    cat.register("live", "Events", Collection(stream, Collection.of(stream, "Event", []).ty))
    seen = []
    e = Engine(spark, cat).load("foreach live.Events.Where(event_type == 'error') => '{event_id}' => mine.Sink\n")
    for q in run_stream(e, {"mine.Sink": lambda df, i, *a: seen.extend(r[0] for r in df.collect())}, available_now=True):
        q.awaitTermination()
    want = [str(r[0]) for r in spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'error'").select("event_id").collect()]
    assert sorted(seen) == sorted(want)


def test_http_requests_are_answered(spark):
    server = RequestServer(timeout=60)
    stream = receive(spark, server)
    cat = Catalog(spark)
    cat.register("http", "Receive", Collection(stream, Collection.of(stream, "Request", []).ty))
    e = Engine(spark, cat).load("""
type Response = { Id : int, Status : int, Body : string }
function handle(Request:Path:equals('/')) => Response { Id = Request.Id, Status = 200, Body = 'home' }
function handle(Request:Path:equals('/health')) => Response { Id = Request.Id, Status = 200, Body = 'ok' }
function handle(Request) => Response { Id = Request.Id, Status = 404, Body = 'nothing at {Request.Path}' }
foreach http.Receive => handle => http.Send
""")
    queries = run_stream(e, {"http.Send": server.send})
    answers = {}

    def ask(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.port}{path}", timeout=60) as r:
                answers[path] = (r.status, r.read().decode())
        except urllib.error.HTTPError as x:
            answers[path] = (x.code, x.read().decode())

    threads = [threading.Thread(target=ask, args=(p,)) for p in ("/", "/health", "/x")]
    [t.start() for t in threads]
    [t.join(90) for t in threads]
    [q.stop() for q in queries]
    server.close()
    time.sleep(0.1)
    assert answers == {"/": (200, "home"), "/health": (200, "ok"), "/x": (404, "nothing at /x")}


def test_requests_are_dropped_once_committed():
    server = RequestServer()
    server.requests.extend((i, "GET", "/", "", None, "") for i in range(5))
    assert [r[0] for r in server.taken(2, 2)] == [2, 3]
    server.drop(3)
    assert len(server.requests) == 2 and [r[0] for r in server.taken(3)] == [3, 4] and server.taken(5) == []
    server.drop(3)
    assert server.dropped == 3
    server.close()


def test_stream_into_a_folder(spark, sf, tmp_path):
    stream = parquet_stream(spark, f"{sf}/events.parquet")
    cat = Catalog(spark)
    cat.register("live", "Events", Collection(stream, Collection.of(stream, "Event", []).ty))
    e = Engine(spark, cat).load(f"foreach live.Events.Where(event_type == 'error') => '{{event_id}}' => file.Write('{tmp_path}/out/')\n")
    for q in run_stream(e, available_now=True):
        q.awaitTermination()
    want = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'error'").count()
    assert spark.read.text(f"{tmp_path}/out/batch=*").count() == want
