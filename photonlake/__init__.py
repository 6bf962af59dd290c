"""photonlake: camera-raw containers, tags, calibration and sensor samples as Spark DataFrames."""
