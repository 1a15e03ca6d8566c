import random

from pyspark.sql import functions as F

from glyphmill.operators.segment import Automaton
from glyphmill.operators.vocabulary import Vocabulary
from glyphmill.streaming.segment import Incremental, Key, segment_stream

V = Vocabulary.hex(s.encode() for s in ["x", "xy", "yz", "xyztu", "zt", "uv", " ", "the", "he "])


def test_incremental_equals_whole():
    rng = random.Random(2)
    m = Automaton(V)
    for _ in range(300):
        data = bytes(rng.choice(b"xyztuv the") for _ in range(rng.randint(0, 60)))
        work, out, at = Incremental(m), [], 0
        while at < len(data):
            n = rng.randint(1, 9)
            out += work.feed(data[at : at + n])
            at += n
        assert out + work.finish() == m.ids(data)
        assert len(work.cost) <= 60


def test_pieces_in_any_order_and_several_texts():
    rng = random.Random(4)
    m = Automaton(V)
    for _ in range(100):
        texts = ["".join(rng.choice("xyztuv the") for _ in range(rng.randint(0, 30))) for _ in range(3)]
        pieces = []
        for text in texts:
            cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 4)))
            parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
            pieces += [(len(pieces) + k, x, k == len(parts) - 1) for k, x in enumerate(parts)]
        pieces += rng.sample(pieces, 2)  # some come twice
        rng.shuffle(pieces)
        saved, got = None, []
        while pieces:
            state = Key(m, saved)
            n = rng.randint(1, 4)
            got += state.take(pieces[:n])
            pieces, saved = pieces[n:], state.dumps()
        assert got == [m.string(i) for text in texts for i in m.expand(m.ids(text.encode()))]
        assert not Key(m, saved).early


def test_stream(spark, tmp_path):
    texts = {"a": "xyztuv the xyz the", "b": "the he xyzxyz"}
    rows = []
    for key, text in texts.items():
        parts = [text[i : i + 5] for i in range(0, len(text), 5)]
        rows += [(i, (key, i, p, i == len(parts) - 1)) for i, p in enumerate(parts)]
    source = tmp_path / "in"
    for batch in range(max(i for i, _ in rows) + 1):
        part = [r for i, r in rows if i == batch]
        spark.createDataFrame(part, "key string, seq long, text string, last boolean").coalesce(1).write.mode("append").parquet(str(source))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("key string, seq long, text string, last boolean").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = segment_stream(stream, V).writeStream.format("memory").queryName("tokens").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    m = Automaton(V)
    got = spark.table("tokens").orderBy("key", "pos").select("key", F.hex("token").alias("t")).collect()
    for key, text in texts.items():
        assert [r.t for r in got if r.key == key] == [m.string(i).hex().upper() for i in m.expand(m.ids(text.encode()))]
