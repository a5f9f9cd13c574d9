"""Feature engine for collections of point structures, graphs, grids and series, on DataFrames."""
