"""Operators of a training-data pipeline. Nothing else in the library imports them."""

from pyspark import cloudpickle

from spokeflow.llm import bpe, licenses, near, negatives, quality, repair, topk, wavelet, words

# Workers need not have the package installed to run the functions of these modules.
for module in (bpe, licenses, near, negatives, quality, repair, topk, wavelet, words):
    cloudpickle.register_pickle_by_value(module)
