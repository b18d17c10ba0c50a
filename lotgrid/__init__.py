"""Land-parcel and gridded-imagery analytics on Spark DataFrames."""
