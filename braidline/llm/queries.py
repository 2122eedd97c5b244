"""The registered corpus queries: one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import byte_bpe as _bpe
from . import exact_dedup as _dedup
from . import jaccard as _jaccard
from . import language as _language
from . import lattice_lm as _lattice_lm
from . import neighbours as _neighbours
from . import packing as _packing
from . import recompression as _recompression
from . import resampling as _resampling
from . import token_files as _token_files
from . import toxicity as _toxicity
from . import warc as _warc
from .common import fold_of, in_fold, table


def op1_exact_dedup(spark, sf_dir):
    return _dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_lattice_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _lattice_lm.score_documents(docs, in_fold("doc_id", 10, 0), public_tokenizers.path("piece_bpe_32k.model"))


def op3_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = _toxicity.train(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 5) != 0)
    scored = docs.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), _toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_warc(spark, sf_dir):
    manifest = _warc.write_archives(table(spark, sf_dir, "pages"))
    return _warc.read_archives(manifest, with_payload=False).drop("url")


def op6_jaccard_join(spark, sf_dir):
    return _jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op8_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder, manifest = _token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return _token_files.token_digests(_token_files.read_token_files(spark, folder, manifest))


def op9_multiprobe_ann(spark, sf_dir):
    return _neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("_id") % 20 == 0)


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = _language.train(docs, fold_of("doc_id", 4) != 2)
    found = docs.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), _language.predict(model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op11_resampling(spark, sf_dir):
    return _resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_substring_dedup(spark, sf_dir):
    return _recompression.substring_dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lattice_lm": op2_lattice_lm,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_files": op8_token_files,
    "op9_multiprobe_ann": op9_multiprobe_ann,
    "op10_language_id": op10_language_id,
    "op11_resampling": op11_resampling,
    "op12_substring_dedup": op12_substring_dedup,
}

ORACLES = {
    "op1_exact_dedup": _dedup.ORACLE,
    "op5_warc": _warc.ORACLE,
    "op11_resampling": _resampling.ORACLE,
    "op12_substring_dedup": _recompression.ORACLE,
}
