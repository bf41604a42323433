"""The queries of the ten operators, over whole tables with production parameters, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquery.llm import ann, html, license, mixing, packing, pii, quality, simhash, suffix, tokenids
from docquery.llm.common import table


def _docs(f, **options):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"), **options)


def queries() -> dict:
    return {
        "op1_pii": _docs(pii.pii_spans),
        "op2_mixing": _docs(mixing.sample),
        "op3_quality": _docs(quality.report),
        "op4_simhash": _docs(simhash.groups),
        "op5_html": lambda spark, sf_dir: html.extract(table(spark, sf_dir, "pages")),
        "op6_suffix": _docs(suffix.repeats),
        "op7_license": _docs(license.scan),
        "op8_ann": lambda spark, sf_dir: ann.neighbours(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0),
        "op9_packing": _docs(packing.pack),
        "op10_tokenids": _docs(tokenids.token_codes),
    }


def oracle_sql() -> dict[str, str]:
    """Models, hashing and bounded errors are beyond SQL; those queries are tested against brute force."""
    return {"op2_mixing": mixing.ORACLE}
