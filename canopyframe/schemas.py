"""Table schemas and the enumerations that results depend on."""

from pyspark.sql import types as T

# Land-cover classes of footprints.
CLASSES = [20, 30, 40, 90, 111, 112, 114, 115, 116, 121, 122, 124, 125, 126]
# Optical bands in storage order.
OPTICAL_BANDS = ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12"]
# No-data marks by source.
NODATA = {"optical": 0, "height": 255, "radar": 0, "elevation": -9999, "cover": 255, "embedding": -128}
# Regions of each continent.
CONTINENTS = {
    "NorthAmerica": ["California", "Cuba"], "SouthAmerica": ["Paraguay", "FrenchGuiana"], "Africa": ["UnitedRepublicofTanzania", "Ghana"],
    "Europe": ["Austria", "Greece"], "SouthAsia": ["Nepal", "ShaanxiProvince"], "Australasia": ["NewZealand"],
}
# Scene classes without a usable surface, and the water class.
BAD_SCENE_CLASSES = [0, 1, 6, 11]
WATER = 80
# Oversampling factor of each 50-wide label bin.
OVERSAMPLING = [1, 1, 1, 1, 2, 2, 4, 5, 7, 10]
MISSION_START = "2019-04-17"
OFFSET_START = "2022-01-25"
EARTH_RADIUS = 6371000.0

FOOTPRINTS = T.StructType([
    T.StructField("tile", T.StringType()), T.StructField("file", T.StringType()), T.StructField("idx", T.LongType()),
    T.StructField("agbd", T.FloatType()), T.StructField("rh98", T.FloatType()),
    T.StructField("lat_decimal", T.FloatType()), T.StructField("lat_offset", T.ShortType()),
    T.StructField("lon_decimal", T.FloatType()), T.StructField("lon_offset", T.ShortType()),
    T.StructField("pft_class", T.ShortType()), T.StructField("region_cla", T.ShortType()),
    T.StructField("S2_date", T.ShortType()), T.StructField("S2_boa_offset", T.ShortType()), T.StructField("region", T.ShortType()),
    T.StructField("year", T.IntegerType()), T.StructField("shard", T.IntegerType()),
])
PIXELS = T.StructType([
    T.StructField("raster_id", T.StringType()), T.StructField("brow", T.IntegerType()), T.StructField("bcol", T.IntegerType()),
    T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("band", T.ShortType()), T.StructField("value", T.DoubleType()),
])
RASTERS = T.StructType([
    T.StructField("raster_id", T.StringType()), T.StructField("epsg", T.IntegerType()), *[T.StructField(k, T.DoubleType()) for k in ("a", "e", "c", "f")],
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("bands", T.IntegerType()), T.StructField("nodata", T.DoubleType()),
])
PLOTS = T.StructType([
    T.StructField("plot_index", T.LongType()), T.StructField("POINT_X", T.DoubleType()), T.StructField("POINT_Y", T.DoubleType()), T.StructField("n", T.IntegerType()),
    T.StructField("AGB_T_HA", T.DoubleType()), T.StructField("varTot", T.DoubleType()), T.StructField("AVG_YEAR", T.IntegerType()),
])
CLASS_EMBEDDINGS = T.StructType([*[T.StructField(f"dim{i}", T.DoubleType()) for i in range(5)], T.StructField("mapping", T.IntegerType())])
