"""Fixed values that results depend on: class tables, colours, defaults, formats."""

# --- fixed values: class order of the cost channels (index = train id) ---
CLASS_NAMES = (
    "road", "sidewalk", "building", "wall", "fence", "pole", "traffic light", "traffic sign",
    "vegetation", "terrain", "sky", "person", "rider", "car", "truck", "bus", "train",
    "motorcycle", "bicycle",
)
# --- fixed values: public label id of each train id 0..18 ---
LABEL_IDS = (7, 8, 11, 12, 13, 17, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 31, 32, 33)
GROUND_CLASSES = (0, 1)
SKY_CLASS = 10
FIRST_INSTANCE_CLASS = 11
FIRST_INSTANCE_LABEL_ID = 24
IGNORE_LABEL = 255

# --- fixed values: geometric types of a segment ---
GROUND, OBJECT, SKY = 0, 1, 2

# --- fixed values: class colours (r, g, b) by train id ---
CLASS_COLOURS = (
    (128, 64, 128), (244, 35, 232), (70, 70, 70), (102, 102, 156), (190, 153, 153),
    (153, 153, 153), (250, 170, 30), (220, 220, 0), (107, 142, 35), (152, 251, 152),
    (70, 130, 180), (220, 20, 60), (255, 0, 0), (0, 0, 142), (0, 0, 70), (0, 60, 100),
    (0, 80, 100), (0, 0, 230), (119, 11, 32),
)
# --- fixed values: thirty instance colours (r, g, b) ---
INSTANCE_COLOURS = (
    (0, 0, 0), (105, 105, 105), (85, 107, 47), (34, 139, 34), (127, 0, 0), (72, 61, 139),
    (0, 139, 139), (70, 130, 180), (210, 105, 30), (0, 0, 139), (50, 205, 50), (218, 165, 32),
    (143, 188, 143), (139, 0, 139), (255, 69, 0), (255, 255, 0), (0, 255, 0), (0, 250, 154),
    (138, 43, 226), (233, 150, 122), (220, 20, 60), (0, 255, 255), (0, 0, 255), (216, 191, 216),
    (255, 0, 255), (30, 144, 255), (219, 112, 147), (255, 20, 147), (238, 130, 238),
    (255, 228, 181),
)
WHITE = (255, 255, 255)

# --- fixed values: image channel statistics ---
CHANNEL_MEAN = (0.290101, 0.328081, 0.286964)
CHANNEL_STD = (0.182954, 0.186566, 0.184475)

# --- fixed values: camera used when a frame has no camera record ---
FALLBACK_CAMERA = {"focal": 1495.46, "baseline": 0.22087, "center_y": 513.9}

# --- fixed values: name patterns ---
STEM_TAIL = "_[a-z].*"
STEM_PARTS = "([a-z]*)_([0-9]*)_([0-9]*)_"

# --- fixed values: model defaults ---
MODEL_DEFAULTS = {
    "sigma_disparity_object": 1.0, "sigma_disparity_ground": 2.0, "sigma_sky": 0.1,
    "pout": 0.15, "pout_sky": 0.4, "pord": 0.2, "pgrav": 0.1, "pblg": 0.04,
    "pground_given_nexist": 0.28, "pobject_given_nexist": 0.44, "psky_given_nexist": 0.28,
    "pnexist_dis": 0.25, "pground": 1.0 / 3.0, "pobject": 1.0 / 3.0, "psky": 1.0 / 3.0,
    "sigma_camera_tilt": 0.05, "sigma_camera_height": 0.05, "epsilon": 3.0,
    "range_objects_z": 10.20, "road_threshold": 0.2,
}
PI = 3.1416
MAX_COST = 1e4

# --- fixed values: start point of a parameter search ---
SEARCH_START = {"w_seg": 4.7095, "w_inst": 0.0031313, "w_disp": 0.0001, "eps": 18.8223,
                "min_size": 3, "size_filter": 25}
