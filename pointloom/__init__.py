"""Range-sensor, inertial and calibration analytics as Spark DataFrame operators."""
