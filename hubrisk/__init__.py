"""hubrisk: Spark-native weather-risk analytics for two-leg itineraries through a hub.

Inputs are Spark DataFrames (flights, hourly weather, METAR, airports); every
operator is a ``DataFrame(s) -> DataFrame`` function parameterised by
:class:`hubrisk.params.Params`.
"""

from hubrisk.params import Params

__all__ = ["Params"]
