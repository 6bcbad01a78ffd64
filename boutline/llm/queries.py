"""Registered queries of the operators, each over its whole table, and the SQL that checks those SQL can express."""

from pyspark.sql import functions as F

from boutline.llm import bpe, decontaminate, fingerprint, langid, near, packing, periodic, quality, quality_sql, ranked, secret_scan, shard, tokenfile, wordpiece

QUERIES, ORACLES = {}, {}


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


@query("op1_quality_rules", quality_sql.QUALITY)
def op1(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir)).drop("rejected_by")


def remainder():
    """crc32 of doc_id as text, modulo 4; rows with 2 are held out, and a null id is neither learned from nor held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, remainder() != 2)
    return langid.identify(docs, model).withColumn("held_out", F.coalesce(remainder() == 2, F.lit(False)))


@query("op3_token_files")
def op3(spark, sf_dir):
    folder = tokenfile.write_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), 2)
    return tokenfile.read_tokens(spark, folder)


@query("op4_packing")
def op4(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


@query("op5_near_dedup")
def op5(spark, sf_dir):
    return near.near_duplicates(documents(spark, sf_dir), width=2, percent=80)


@query("op6_token_counts")
def op6(spark, sf_dir):
    return wordpiece.token_counts(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


@query("op7_sharding")
def op7(spark, sf_dir):
    rows = shard.feistel_shards(documents(spark, sf_dir), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_secret_scan")
def op10(spark, sf_dir):
    return secret_scan.secret_spans(documents(spark, sf_dir))


@query("op8_fingerprints")
def op8(spark, sf_dir):
    return fingerprint.compare_edits(documents(spark, sf_dir))


@query("op9_byte_bpe")
def op9(spark, sf_dir):
    return bpe.round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    return periodic.run_digests(documents(spark, sf_dir), places=periodic.planted_places)


def benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


@query("op12_ranked_search", ranked.SEARCH)
def op12(spark, sf_dir):
    return ranked.search(documents(spark, sf_dir), benchmark(spark, sf_dir))


@query("op13_decontamination", decontaminate.CONTAMINATION)
def op13(spark, sf_dir):
    return decontaminate.contamination(documents(spark, sf_dir), benchmark(spark, sf_dir))
