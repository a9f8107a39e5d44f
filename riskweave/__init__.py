"""riskweave: transaction-risk (AML) analytics as Spark DataFrame jobs.

Every operator takes and returns DataFrames; planning is left to Catalyst/AQE.
"""

from riskweave.config import RiskConfig, DEFAULT_CONFIG, with_config

__all__ = ["RiskConfig", "DEFAULT_CONFIG", "with_config"]
