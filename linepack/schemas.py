"""Declared schemas of the data model; files are read with these, never inferred."""

from pyspark.sql import types as T

CORPUS = T.StructType([T.StructField("text", T.StringType())])
ITEM = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("choices", T.ArrayType(T.StringType())), T.StructField("context_options", T.ArrayType(T.StringType())),
    T.StructField("context", T.StringType()), T.StructField("continuation", T.StringType()), T.StructField("gold", T.IntegerType()),
])
TASK = T.StructType([T.StructField("label", T.StringType()), T.StructField("task_type", T.StringType()), T.StructField("num_fewshot", T.IntegerType()), T.StructField("continuation_delimiter", T.StringType())])
BASELINE = T.StructType([T.StructField("label", T.StringType()), T.StructField("random_baseline", T.DoubleType())])
METRIC = T.StructType([T.StructField("run", T.StringType()), T.StructField("slice", T.StringType()), T.StructField("label", T.StringType()), T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])
#: Names of the special tokens of a vocabulary, in id order.
SPECIALS = ["<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>", "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>", "<|sot|>", *[f"<|bot_{k}|>" for k in range(1, 17)], "<|eot|>", "<|sot_tail|>"]
