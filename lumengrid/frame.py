"""The public interface: an immutable frame of images with chained operators.

    from lumengrid import ImageFrame
    ImageFrame.from_pixels(df).grayscale().box_blur(2).blend(other, "screen").auto_tone().pixels

Every method returns a new frame and builds a plan; nothing runs before an action on `pixels`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumengrid.functions.color import Gradient
from lumengrid import plugins
from lumengrid.operators import blend, collage, point, raster, spatial, stats, tiles, warp
from lumengrid.operators.canvas import Canvas, Layer, render
from lumengrid.operators.geometry import Path
from lumengrid.plans.views import new_image, sizes, to_images, to_pixels
from lumengrid.plugins import Parameter, PluginResult, plugin
from lumengrid.sources import images

class ImageFrame:
    """Images as pixel rows (image_id, x, y, r, g, b, a)."""

    def __init__(self, pixels: DataFrame):
        self.pixels = pixels

    @classmethod
    def from_pixels(cls, pixels: DataFrame) -> ImageFrame:
        return cls(pixels.select("image_id", "x", "y", "r", "g", "b", "a"))

    @classmethod
    def from_images(cls, rows: DataFrame) -> ImageFrame:
        """From image rows (image_id, width, height, rgba)."""
        return cls(to_pixels(rows))

    @classmethod
    def open(cls, spark: SparkSession, path: str, recursive: bool = False) -> ImageFrame:
        """From files; the image_id is the path, and files that cannot be read are left out."""
        return cls(to_pixels(images.read_images(spark, path, recursive).where("error is null").withColumnRenamed("path", "image_id")))

    @classmethod
    def blank(cls, spark: SparkSession, width: int, height: int, color=(0, 0, 0, 0)) -> ImageFrame:
        return cls(new_image(spark, width, height, color))

    def save(self, folder: str, kind: str = "png") -> None:
        """One PNG or GIF file for each image."""
        images.write_images(to_images(self.pixels), folder, kind)

    def add_images(self, other: ImageFrame) -> ImageFrame:
        """The images of both frames."""
        return ImageFrame(self.pixels.unionByName(other.pixels))

    def images(self) -> DataFrame:
        return to_images(self.pixels)

    def sizes(self) -> DataFrame:
        return sizes(self.pixels)

    def histogram(self, skip_transparent: bool = False) -> DataFrame:
        return stats.histogram(self.pixels, skip_transparent)

    def within(self, change: Callable[[ImageFrame], ImageFrame], areas: list[tuple[Path, int]] | None = None, mask: DataFrame | None = None) -> ImageFrame:
        """A chain applied inside areas (path, feather) and a mask only."""
        return ImageFrame(raster.apply_in_area(self.pixels, lambda p: change(ImageFrame(p)).pixels, areas, mask))

    def blend(self, top: ImageFrame, mode: str = "normal", opacity: float = 1.0, x: int = 0, y: int = 0) -> ImageFrame:
        if opacity == 1.0:
            return ImageFrame(blend.blend(self.pixels, top.pixels, mode, x, y))
        return ImageFrame(blend.blend_opacity(self.pixels, top.pixels, mode, opacity, x, y))

    def draw(self, top: ImageFrame, x: int, y: int) -> ImageFrame:
        return ImageFrame(blend.draw_at(self.pixels, top.pixels, x, y))

    def mask(self, other: ImageFrame) -> ImageFrame:
        return ImageFrame(blend.apply_mask(self.pixels, other.pixels))

    def tiles(self, tile: int, overlap: int, change: Callable) -> ImageFrame:
        return ImageFrame(tiles.process(self.pixels, tile, overlap, change))

    def gradient_map(self, gradient: Gradient) -> ImageFrame:
        return ImageFrame(point.gradient_map(self.pixels, gradient))

    def run(self, name: str, **parameters) -> PluginResult:
        """A plugin by its name, with its parameters checked before any plan is made."""
        return plugins.run(name, self, parameters)

    def apply(self, name: str, **parameters) -> ImageFrame:
        """A plugin's first image, or its first canvas drawn."""
        made = self.run(name, **parameters)
        if made.images:
            return made.images[0]
        if made.canvases:
            return ImageFrame(render(made.canvases[0]))
        return ImageFrame(made.layers[0].pixels)


def _chained(change: Callable[..., DataFrame]) -> Callable:
    def method(self: ImageFrame, *args, **kwargs) -> ImageFrame:
        return ImageFrame(change(self.pixels, *args, **kwargs))

    method.__name__, method.__doc__ = change.__name__, change.__doc__
    return method


for _module, _names in (
    (point, "map_rgb map_lut set_pixel clear_color add sub mul div crop flip_horizontal flip_vertical opacity invert grayscale threshold posterize brightness contrast exposure saturation vibrance photo_filter photo_filter_preset noise rotate_hue"),
    (spatial, "apply_kernel smooth box_blur median despeckle surface_blur spread_alpha"),
    (raster, "gaussian_blur motion_blur lens_blur median_wide smooth_skin focus_blur paint stroke"),
    (warp, "resize resize_nearest rotate rotate_quarter pinch ripple"),
    (stats, "auto_tone auto_color"),
):
    for _name in _names.split():
        setattr(ImageFrame, _name, _chained(getattr(_module, _name)))


@plugin(
    "collage", "A collage of the frame's images.",
    style=Parameter("string", "grid", choices=collage.STYLES), columns=Parameter("integer", 2, low=1), rows=Parameter("integer", 2, low=1),
    width=Parameter("integer", 512, low=1), height=Parameter("integer", 512, low=1), seed=Parameter("integer", 0),
    rotation_min=Parameter("float", 0.0), rotation_max=Parameter("float", 0.0), scale_min=Parameter("float", 1.0, low=0.0), scale_max=Parameter("float", 1.0, low=0.0),
)
def _collage(frame: ImageFrame, **p) -> PluginResult:
    pixels = collage.collage(frame.pixels, p["style"], p["columns"], p["rows"], (p["width"], p["height"]), p["seed"], (p["rotation_min"], p["rotation_max"]), (p["scale_min"], p["scale_max"]))
    own = Canvas.blank(pixels, p["width"], p["height"], "Collage").add_layer(Layer(pixels, size=(p["width"], p["height"]), name="collage"))
    return PluginResult().add_canvas(own)
