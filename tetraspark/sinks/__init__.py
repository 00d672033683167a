"""Writers of converted meshes."""
