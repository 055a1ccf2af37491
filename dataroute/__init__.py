"""Routing of datasets, paths and results on PySpark."""

from dataroute.functions import *  # noqa: F403
from dataroute.operators import *  # noqa: F403
from dataroute.plans import *  # noqa: F403
from dataroute.sources import *  # noqa: F403
