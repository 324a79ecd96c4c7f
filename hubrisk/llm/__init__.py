"""Operators for large training-data pipelines (quality, secrets, archives, decontamination,
url filters, duplicate removal, language-model scores, licences, similarity joins, packing,
fingerprints, hard negatives, divergence of sources).

Each module holds one operator with a general interface; ``queries.py`` registers one thin
``opN_<name>`` query per operator. Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Task functions travel to the Python workers by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
