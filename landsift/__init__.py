"""Land-parcel analytics as Spark DataFrame jobs."""

PARCEL_KEY = ["ko_id", "parcel_number"]

__all__ = ["PARCEL_KEY"]
