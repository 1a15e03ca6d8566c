"""The queries by name; each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import filters as X
from glyphmill.operators import clean, mining, segment, stats, train
from glyphmill.operators.vocabulary import Vocabulary
from glyphmill.sources import text as sources

#: The vocabulary of the queries: common strings of the corpus over a base.
STRINGS = [
    " ", "e", "n", "t", "a", "i", "r", "o", "s", "h", "l", "d", "u", "er", "en", "th", "on", "de", "an", "in", "re", "ti", "es",
    "the", "ion", "ing", "tion", "and ", " the ", ".", ", ",
]
HEX = Vocabulary.hex(s.encode() for s in STRINGS)
BITS = Vocabulary.bits(s.encode() for s in STRINGS)
TOP, TRAINED, BUILT = 40, 22, 28


def _docs(spark: SparkSession, d: str, table: str = "documents") -> DataFrame:
    found = spark.read.parquet(f"{d}/{table}.parquet")
    return sources.spread(found) if table == "documents" else found


def byte_histogram(spark, d):
    return stats.byte_histogram(_docs(spark, d))


def top_bytes(spark, d):
    return stats.top_bytes(_docs(spark, d), TOP)


def char_histogram(spark, d):
    return stats.char_histogram(_docs(spark, d))


def reserved_chars(spark, d):
    return stats.reserved_chars(_docs(spark, d))


def hex_digit_counts(spark, d):
    return stats.hex_digit_counts(_docs(spark, d))


def bigram_pairs(spark, d):
    return stats.bigrams(_docs(spark, d))


def _filtered(*names):
    return lambda spark, d: _docs(spark, d).select("doc_id", X.compose(names)(F.col("text")).alias("text"))


def _lined(caps, words):
    return lambda spark, d: _docs(spark, d).select("doc_id", X.filter_lines(F.col("text"), caps, words).alias("text"))


def _tokens(vocabulary, longest):
    return lambda spark, d: segment.written(_docs(spark, d), vocabulary, longest)


def token_counts(spark, d):
    return segment.greedy_counts(_docs(spark, d), HEX)


def token_stats(spark, d):
    scanned = _docs(spark, d).agg(F.sum(F.octet_length("text")).alias("scanned_bytes"))
    return stats.measures(token_counts(spark, d), len(HEX), scanned)


def token_stats_report(spark, d):
    return stats.report(token_counts(spark, d))


def optimal_cost(spark, d):
    return _docs(spark, d, "benchmark").select("item_id", segment.optimal_cost(F.col("text"), HEX).alias("cost"))


def optimal_cost_documents(spark, d):
    return _docs(spark, d).select("doc_id", segment.optimal_cost(F.col("text"), HEX).alias("cost"))


def optimal_tokens(spark, d):
    tokens = segment.optimal(F.col("text"), BITS, expand_literals=False)
    return _docs(spark, d, "conversations").select("conv_id", "turn", F.transform(tokens, F.hex).alias("t")).select("conv_id", "turn", F.array_join("t", " ").alias("tokens"))


def optimal_token_counts(spark, d):
    return segment.optimal_counts(_docs(spark, d), HEX).where("kind in ('token', 'literal')").select("kind", F.col("left").alias("token"), "cnt")


def optimal_pairs(spark, d):
    return segment.optimal_counts(_docs(spark, d), HEX, pairs=True).where("kind = 'pair'").select("left", "right", "cnt")


def _of_benchmark(spark, d, pairs=False):
    return segment.optimal_counts(_docs(spark, d, "benchmark"), HEX, pairs=pairs)


def optimal_benchmark_counts(spark, d):
    return _of_benchmark(spark, d).where("kind in ('token', 'literal')").select("kind", F.col("left").alias("token"), "cnt")


def optimal_benchmark_pairs(spark, d):
    return _of_benchmark(spark, d, pairs=True).where("kind = 'pair'").select("left", "right", "cnt")


def optimal_benchmark_report(spark, d):
    """The most frequent tokens of optimal segmentation, with literals written by the fallback."""
    return stats.report(segment.optimal_report(_docs(spark, d, "benchmark"), HEX))


def top_substrings(spark, d):
    found = mining.top_substrings(_docs(spark, d), TOP)
    return spark.createDataFrame([(s.hex().upper(), len(s), n) for s, n in found], "gram string, length int, cnt long")


def top_substrings_filtered(spark, d):
    found = mining.top_substrings(_docs(spark, d), 2 * TOP, filters=("caps", "words"))
    return spark.createDataFrame([(s.hex().upper(), len(s), n) for s, n in found], "gram string, length int, cnt long")


def suffix_tokens(spark, d):
    return segment.suffix_tokens(HEX.frame(spark))


def vocab_build_top(spark, d):
    v = Vocabulary.hex()
    v.add_ranked(train.ranked_bytes(_docs(spark, d)), BUILT)
    return spark.createDataFrame([(i, t.string.hex().upper(), t.mandatory) for i, t in enumerate(v)], "token_id int, token string, mandatory boolean")


def _trained(spark, d, how, table="documents"):
    docs = _docs(spark, d, table).select("text")
    return train.frame(spark, how(train.evaluator(docs), docs))


def bpe_train(spark, d):
    return _trained(spark, d, lambda e, _: train.train_by_strings(e, Vocabulary.hex(), TRAINED))


def bpe_train_ids(spark, d):
    return _trained(spark, d, lambda e, _: train.train_by_ids(e, Vocabulary.hex(), TRAINED)[0])


def prune_simple(spark, d):
    return _trained(spark, d, lambda e, docs: train.prune_rarest(e, HEX, len(HEX) - 6, train.changer(docs)))


def prune_best(spark, d):
    return _trained(spark, d, lambda e, docs: train.prune_best(e, HEX, len(HEX) - 4, costs=train.coster(docs)), "benchmark")


def substring_vocabulary(spark, d):
    return _trained(spark, d, lambda _, docs: train.substring_vocabulary(docs, 32))


def select_best_strategy(spark, d):
    best = train.select_best(_docs(spark, d, "benchmark").select("text"), 8)
    return train.frame(spark, Vocabulary.from_json(best))


def size_sweep(spark, d):
    return train.size_sweep(_docs(spark, d, "benchmark").select("text"), (17, 19, 21))


def decoded_tokens(spark, d):
    return segment.round_trip(_docs(spark, d, "conversations"), BITS, ("conv_id", "turn"))


def strip_headers(spark, d):
    return clean.strip_headers(_docs(spark, d))


def clean_text(spark, d):
    return clean.clean_text(_docs(spark, d))


def merge_fragments(spark, d):
    return clean.fragments(_docs(spark, d))


def chunk_sample(spark, d):
    return sources.sample(_docs(spark, d), 4).select("doc_id", "text")


def sample_pieces(spark, d):
    return sources.sample_pieces(_docs(spark, d), 256)


def text_directories(spark, d):
    return _docs(spark, d).select("doc_id", sources.directory_of(F.col("doc_id")).alias("directory"))


def prepare(spark, d):
    return sources.prepare(_docs(spark, d), ("caps", "words"))


QUERIES = {
    "byte_histogram": byte_histogram,
    "top_bytes": top_bytes,
    "char_histogram": char_histogram,
    "reserved_chars": reserved_chars,
    "hex_digit_counts": hex_digit_counts,
    "bigram_pairs": bigram_pairs,
    "filter_reserved": _filtered("reserved"),
    "filter_caps": _filtered("caps"),
    "filter_words": _filtered("words"),
    "filter_caps_words": _filtered("caps", "words"),
    "filter_lines_caps": _lined(True, False),
    "filter_lines_words": _lined(False, True),
    "filter_lines_caps_words": _lined(True, True),
    "tokenize_bytes_hex": _tokens(HEX, longest=False),
    "tokenize_bytes_bits": _tokens(BITS, longest=False),
    "tokenize_greedy": _tokens(HEX, longest=True),
    "token_counts": token_counts,
    "token_stats": token_stats,
    "token_stats_report": token_stats_report,
    "optimal_cost": optimal_cost,
    "optimal_cost_documents": optimal_cost_documents,
    "optimal_tokens": optimal_tokens,
    "optimal_token_counts": optimal_token_counts,
    "optimal_pairs": optimal_pairs,
    "optimal_benchmark_counts": optimal_benchmark_counts,
    "optimal_benchmark_pairs": optimal_benchmark_pairs,
    "optimal_benchmark_report": optimal_benchmark_report,
    "top_substrings": top_substrings,
    "top_substrings_filtered": top_substrings_filtered,
    "suffix_tokens": suffix_tokens,
    "vocab_build_top": vocab_build_top,
    "bpe_train": bpe_train,
    "bpe_train_ids": bpe_train_ids,
    "prune_simple": prune_simple,
    "prune_best": prune_best,
    "substring_vocabulary": substring_vocabulary,
    "select_best_strategy": select_best_strategy,
    "size_sweep": size_sweep,
    "decoded_tokens": decoded_tokens,
    "strip_headers": strip_headers,
    "clean_text": clean_text,
    "merge_fragments": merge_fragments,
    "chunk_sample": chunk_sample,
    "sample_pieces": sample_pieces,
    "text_directories": text_directories,
    "prepare": prepare,
}
