"""Fixed schemas of what is read and written; nothing is inferred."""

from pyspark.sql import types as T

ENTITY = T.StructType([T.StructField("entity_group", T.StringType()), T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType())])
ENTITIES = T.ArrayType(ENTITY)
ENVELOPE = T.StructType([T.StructField("input_file", T.StringType()), T.StructField("output_file", T.StringType()), T.StructField("entities", ENTITIES)])
ENTITY_MAP = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
CHUNK = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("entities", ENTITY_MAP)])
QA_PAIR = T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])
SIGNALS = "struct<meds:array<string>,doses:array<string>,diso:array<string>,forms:array<string>>"
METRICS = ("faithfulness", "answer_relevance", "context_relevance", "context_precision", "context_recall", "bert_precision", "bert_recall", "bert_f1")
