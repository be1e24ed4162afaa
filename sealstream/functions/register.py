"""Register the open-JSON codecs and the proof table function for SQL use."""

from pyspark.sql import SparkSession

from sealstream.functions import codecs as K
from sealstream.functions.proofs import register_describe


def register_codecs(spark: SparkSession) -> None:
    """SQL functions ``canonical_json(text)``, ``json_to_cbor(text)``, ``record_meta(bytes)``
    and the table function ``describe_proof(bytes)``."""
    spark.udf.register("canonical_json", K.canonical_json)
    spark.udf.register("json_to_cbor", K.json_to_cbor)
    spark.udf.register("record_meta", K.record_meta)
    register_describe(spark)
