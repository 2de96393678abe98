"""Analytics on 3D point clouds and meshes, as Spark DataFrames."""
