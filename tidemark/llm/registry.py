"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from tidemark.llm.ann import OP9_SQL, op9_ann
from tidemark.llm.chat import OP8_SQL, op8_chat
from tidemark.llm.decontaminate import OP10_SQL, op10_decontaminate
from tidemark.llm.hmm import op5_hmm
from tidemark.llm.licenses import op3_licenses
from tidemark.llm.minhash import OP4_SQL, op4_near_duplicates
from tidemark.llm.mixing import OP2_SQL, op2_mixing
from tidemark.llm.token_counts import op7_token_counts
from tidemark.llm.toxicity import op1_toxicity
from tidemark.llm.warc import OP6_SQL, op6_warc


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_toxicity": op1_toxicity,
        "op2_mixing": op2_mixing,
        "op3_licenses": op3_licenses,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_hmm": op5_hmm,
        "op6_warc": op6_warc,
        "op7_token_counts": op7_token_counts,
        "op8_chat": op8_chat,
        "op9_ann": op9_ann,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict:
    return {"op2_mixing": OP2_SQL, "op4_near_duplicates": OP4_SQL, "op6_warc": OP6_SQL, "op8_chat": OP8_SQL, "op9_ann": OP9_SQL, "op10_decontaminate": OP10_SQL}
