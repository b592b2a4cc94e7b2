"""attesta.operators.graph under the name that this subpackage knows it by."""

import sys

from attesta.operators import graph

sys.modules[__name__] = graph
