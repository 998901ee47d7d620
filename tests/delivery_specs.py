from millrace import ColumnSpec, ForeignKey, TableSpec

RESTAURANTS = TableSpec(
    name="restaurants",
    id_column="id",
    columns=(
        ColumnSpec("id", "integer", nullable=False),
        ColumnSpec("name", nullable=False),
        ColumnSpec("lat", "float", nullable=False),
        ColumnSpec("lon", "float", nullable=False),
        ColumnSpec("cuisine"),
        ColumnSpec("avg_rating", "float"),
        ColumnSpec("prep_capacity", "integer"),
    ),
    latitude=("lat",),
    longitude=("lon",),
)
RIDERS = TableSpec(
    name="riders",
    id_column="id",
    columns=(
        ColumnSpec("id", "integer", nullable=False),
        ColumnSpec("lat", "float", nullable=False),
        ColumnSpec("lon", "float", nullable=False),
        ColumnSpec("vehicle_type"),
        ColumnSpec("completed_orders", "integer"),
        ColumnSpec("shift_hours", "float"),
        ColumnSpec("current_load", "integer"),
        ColumnSpec("rider_call_sign"),
    ),
    latitude=("lat",),
    longitude=("lon",),
)
ORDERS = TableSpec(
    name="orders",
    id_column="id",
    columns=(
        ColumnSpec("id", "integer", nullable=False),
        ColumnSpec("restaurant_id", "integer", nullable=False),
        ColumnSpec("rider_id", "integer", nullable=False),
        ColumnSpec("drop_lat", "float"),
        ColumnSpec("drop_lon", "float"),
        ColumnSpec("order_size", "integer"),
        ColumnSpec("order_value", "float"),
        ColumnSpec("timestamp", "datetime", nullable=False),
        ColumnSpec("promised_eta", "integer"),
        ColumnSpec("actual_delivery_time_min", "float"),
        ColumnSpec("order_status"),
        ColumnSpec("promo_code_used"),
    ),
    foreign_keys=(ForeignKey("restaurant_id", "restaurants", "id"), ForeignKey("rider_id", "riders", "id")),
    latitude=("drop_lat",),
    longitude=("drop_lon",),
    timestamps=("timestamp",),
    targets=("actual_delivery_time_min",),
)
SPECS = [RESTAURANTS, RIDERS, ORDERS]
